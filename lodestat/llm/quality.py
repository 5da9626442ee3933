"""Quality score by compression: how much better a text compresses with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from blocks of good and bad labelled text. A text is cut into blocks of fixed size, and each block
is compressed with either dictionary, so the dictionary matters as much at the end of a long text as at its start. The difference of
the sizes per byte becomes a score by logistic calibration on labelled rows that built no dictionary.
"""

from __future__ import annotations

import dataclasses
import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import each_text, materialise, unit_hash, whole_text

BLOCK = 1024
#: Documented bounds of the fit: labelled rows per class that offer text to the dictionaries, labelled rows for the calibration, and
#: blocks per class that build a dictionary.
DICTIONARY_ROWS, CALIBRATION_ROWS, DICTIONARY_BLOCKS = 3_000, 8_000, 4_000
DICTIONARY_BYTES = 112_640


@dataclasses.dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    level: int = 3


def pieces(text: str, block: int = BLOCK) -> list[bytes]:
    body = text.encode("utf-8", "surrogatepass")
    return [body[i : i + block] for i in range(0, len(body), block)]


@functools.lru_cache(4)
def _pair(good: bytes, bad: bytes, level: int):
    import zstandard

    out = []
    for data in (good, bad):
        known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
        known.precompute_compress(level=level)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))
    return out


def features(text: str, good: bytes, bad: bytes, level: int = 3) -> tuple[float, float, float]:
    """Size difference per byte over the whole text, in its worst block, and 1 / (1 + blocks); zeros for an empty text."""
    first, second = _pair(good, bad, level)
    total = n = 0
    worst = math.inf
    parts = pieces(text)
    for part in parts:
        diff = len(second.compress(part)) - len(first.compress(part))
        total += diff
        n += len(part)
        if len(part) >= BLOCK // 4 or len(parts) == 1:
            worst = min(worst, diff / len(part))
    if not n:
        return 0.0, 0.0, 1.0
    return total / n, worst, 1.0 / (1 + len(parts))


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their products with the shortness, so short texts can have their own slope."""
    return np.column_stack([x, x[:, :2] * x[:, 2:3]])


def score_text(text: str, model: Model) -> float:
    x = (expand(np.array([features(text, model.good, model.bad, model.level)])) - model.mean) / model.scale
    z = float(x[0] @ np.array(model.weights[1:]) + model.weights[0])
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, balance: float = 0.5, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) by Newton steps; ``balance`` 1 weighs both classes alike, 0 as they come."""
    a = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, y.mean(), 1 - y.mean())
    weight = np.power(0.5 / np.maximum(share, 1e-9), balance)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (weight * (p - y)) + ridge * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def build_dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:] or b"\n" * 8


def fit(labelled: DataFrame, label: str = "label", key: str = "doc_id", text: str = "text", seed: str = "quality") -> Model:
    """Fit on the rows of ``labelled`` (``label`` 1 good, 0 bad; others are ignored).

    Half of the rows, by a hash of the key, offer blocks of their whole texts to the dictionaries, of which about ``DICTIONARY_BLOCKS``
    per class are drawn by hash; the others calibrate. Without two classes the score is constant.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(key).alias("id"), F.col(label).cast("int").alias("label"), whole_text(text).alias("body"),
        unit_hash(F.col(key), seed=seed).alias("u"),
    )
    cut = rows.where("u < 0.5").select("id", "label", F.posexplode(_blocks(F.col("body"))).alias("at", "block"))
    cut = cut.withColumn("pick", unit_hash(F.col("id"), F.col("at"), seed=seed))
    sizes = {r["label"]: r["count"] for r in cut.groupBy("label").count().collect()}
    share = {c: min(1.0, DICTIONARY_BLOCKS / n) for c, n in sizes.items()}
    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    if share:
        drawn = cut.where(F.col("pick") < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
        for r in drawn.select("label", "block").limit(4 * DICTIONARY_BLOCKS).collect():
            blocks[r["label"]].append(r["block"].encode("utf-8", "surrogatepass"))
    good, bad = build_dictionary(sorted(blocks[1])), build_dictionary(sorted(blocks[0]))
    found = each_text(rows.where("u >= 0.5"), ["label"], lambda t: features(t, good, bad), "a double, b double, c double", "body")
    found = sorted(found.limit(4 * CALIBRATION_ROWS).collect())
    y = np.array([r["label"] for r in found], dtype=float)
    if len(set(y)) < 2:
        odds = (len(blocks[1]) + 1) / (len(blocks[0]) + 1)
        return Model(good, bad, (math.log(odds), *[0.0] * 5), (0.0,) * 5, (1.0,) * 5)
    x = expand(np.array([[r["a"], r["b"], r["c"]] for r in found]))
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    return Model(good, bad, tuple(logistic((x - mean) / scale, y)), tuple(mean), tuple(scale))


def _blocks(text: Column) -> Column:
    """Blocks of characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``key`` (and ``extra`` columns), ``score`` from 0 to 1, ``predicted`` 1 if at least 0.5.

    Missing and empty texts get the score of no evidence; repeated rows give repeated rows; texts are compressed whole.
    """

    def row(value: str) -> tuple:
        s = score_text(value, model)
        return s, int(s >= 0.5)

    return each_text(docs, [key, *(extra or [])], row, "score double, predicted int", text)


def fit_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: str = "quality") -> Model:
    """Fit on documents with a row in ``labels`` (``key, quality``) whose crc32 of the key as text, modulo 3, isn't 1.

    At most ``DICTIONARY_ROWS`` rows of either class and ``CALIBRATION_ROWS`` more are drawn by a hash of the key. The keys drawn are
    broadcast, at most as many as these bounds say, so the documents aren't shuffled.
    """
    marks = labels.select(F.col(key).alias("__id"), F.col("quality").alias("__quality")).where(F.col("__quality").isin(0, 1))
    marks = marks.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__quality").alias("__quality"))
    marks = marks.withColumn("__u", unit_hash(F.col("__id"), seed=seed))
    parts = [marks.where((F.col("__u") < 0.5) & (F.col("__quality") == c)).orderBy("__u", "__id").limit(DICTIONARY_ROWS) for c in (0, 1)]
    parts.append(marks.where(F.col("__u") >= 0.5).orderBy("__u", "__id").limit(CALIBRATION_ROWS))
    drawn = parts[0].union(parts[1]).union(parts[2])
    rows = docs.select(key, "text").join(F.broadcast(drawn.select("__id", "__quality")), F.col(key) == F.col("__id"))
    return fit(materialise(rows.select(key, "text", F.col("__quality").alias("label"))), key=key, seed=seed)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` predicted good, all columns."""
    schema = docs.schema
    names = docs.columns

    at = names.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [score_text(t.as_py() or "", model) >= 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, schema)
