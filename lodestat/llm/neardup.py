"""Near duplicates by SetSketch registers.

A document's set of word shingles becomes ``REGISTERS`` exponentially spaced registers: the minimum of an exponentially distributed
hash, truncated to a power of ``SPACING``. Sketches merge by their maximum and collide about as often as sets are alike. Bands of
registers propose buckets; within a bucket every document is compared with a pivot, the member with most neighbours, instead of with
each other; a joint likelihood of the registers rules out what can't be alike, and the rest is confirmed on the full sets. Documents
of a bucket that are then still apart are compared with each other where an exact bound on what they can share allows a link at all:
no link is given up.
Equal sets are one vertex from the start, so a text copied a million times is compared once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.common import materialise, splitmix, text_bytes, whole_text
from lodestat.llm.shingles import shingle_sets

REGISTERS, ROWS = 100, 4
SPACING, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SEEDS, FACTORS = splitmix(REGISTERS, 17), splitmix(REGISTERS, 19) | np.uint64(1)
#: Parts of a pivot's shingles that texts are compared by before any text moves.
PARTS = 256
#: Log likelihood ratio beyond which a pair can't be alike enough.
SURE = 25.0


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set, as unsigned 16-bit numbers; the sketch of a union is the element-wise maximum."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ SEEDS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    waits = -np.log1p(-np.maximum(least.astype(np.float64), 1.0) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(waits) / math.log(SPACING)), 0, TOP + 1).astype(np.uint16)


def bands(sketch: np.ndarray) -> list[int]:
    """One 64-bit key per band of ``ROWS`` registers."""
    rows = sketch.reshape(-1, ROWS)
    return [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8, key=bytes([i])).digest(), "little", signed=True) for i, r in enumerate(rows)]


def likely(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, threshold: float) -> bool:
    """Whether the joint likelihood of two sketches leaves a similarity of ``threshold`` possible."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = min(u / v, v / u)
    if most < threshold - 1e-12:
        return False
    up, down = int((a > b).sum()), int((a < b).sum())
    same = REGISTERS - up - down
    j = np.linspace(0, most, 201)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (SPACING - 1) / SPACING) / math.log(SPACING)

    p_up, p_down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    ratio = up * np.log(p_up) + down * np.log(p_down) + same * np.log(np.clip(1 - p_up - p_down, 1e-12, 1))
    return bool(ratio.max() - ratio[j >= threshold - 0.01].max() < SURE)


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, digest`` (of the set), ``sketch`` and ``bands`` per row; a text without words has no digest."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, keys = [], [], [], []
            for found in shingle_sets(*text_bytes(batch.column(1))):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                made = registers(found) if len(found) else None
                sketches.append(made.tobytes() if len(found) else None)
                keys.append(bands(made) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "digest", "sketch", "bands"],
            )

    return docs.select(F.col(key).alias("id"), whole_text(text).alias("body")).mapInArrow(run, schema)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have 100 * common >= percent * union. ``texts``: ``id, n, sketch, body``."""
    kind = pairs.schema["a"].dataType
    # copies of a key mustn't multiply pairs; each side adds its columns under its own name
    left, right = (texts.select(*[F.col(c).alias(f"{s}_{c}" if c != "id" else s) for c in ("id", "n", "sketch", "body")]) for s in "ab")
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch", "a_body", "b_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                maybe = [
                    likely(np.frombuffer(x.as_py(), np.uint16), np.frombuffer(y.as_py(), np.uint16), m.as_py(), n.as_py(), percent / 100)
                    for m, n, x, y in zip(*[batch.column(i) for i in range(2, 6)])
                ]
                batch = batch.filter(pa.array(maybe, pa.bool_()))
                if not batch.num_rows:
                    continue
                alike = []
                sets = zip(shingle_sets(*text_bytes(batch.column(6))), shingle_sets(*text_bytes(batch.column(7))))
                for x, y in sets:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    alike.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return rows.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, label``: the smallest id reachable, for every end of an edge. Labels spread along edges and then jump to their label's label."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"))
    labels = materialise(labels)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("near")), "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        step = step.join(jump, "label", "left").select("id", "old", F.coalesce("jump", "label").alias("label"))
        step = materialise(step)
        labels = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id, kept``.

    Texts are linked when the distinct five-word shingles (lower-cased A-Z, words parted by ASCII white space) satisfy 100 * common >=
    percent * union; shorter texts are one shingle; missing texts and texts without words are linked with nothing. ``component_id``
    is the smallest key reachable over links, ``kept`` whether it is the row's own. Rows that share a key count as linked; if their
    texts differ, one of them stands for the key. Rows with a missing key are linked with nothing and kept. Other columns are ignored;
    an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    drawn = materialise(sketch(docs, key, text))
    known = drawn.where("id IS NOT NULL AND digest IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("n_shingles", "sketch", "bands")).alias("s"))
    classes = materialise(classes.select("digest", "rep", F.col("s.n_shingles").alias("n"), F.col("s.sketch").alias("sketch"), F.col("s.bands").alias("bands")))
    cells = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialise(cells.join(shared, "cell"))
    spark = docs.sparkSession
    labels = spark.createDataFrame([], f"id {kind}, label {kind}")
    if not members.isEmpty():
        degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
        members = materialise(members.join(degree, "id").select("cell", "id", "n", "degree"))
        wanted = members.select("id").distinct()
        own = classes.select(F.col("rep").alias("id"), "n", "sketch", "bands").dropDuplicates(["id"])
        source = docs.select(F.col(key).alias("id"), whole_text(text).alias("body"))
        texts = source.join(own.join(wanted, "id", "left_semi"), "id").select("id", "n", "sketch", "bands", "body").dropDuplicates(["id"])
        labels = _link(members, materialise(texts), percent, kind)
    twins = known.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    labels = _join_twins(labels, twins, known, classes, kind)
    label = labels.select(F.col("id").alias("rep"), "label")
    named = classes.select("digest", "rep").join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = drawn.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _join_twins(labels: DataFrame, twins: DataFrame, known: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """Joins the components that hold different texts under one key."""
    if twins.isEmpty():
        return labels
    held = known.join(twins.select("id"), "id", "left_semi").select("id", "digest").distinct()
    links = held.join(classes.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return components(links.union(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))


def shareable(texts: DataFrame) -> DataFrame:
    """``id, most, bands``: how many shingles of a text are in any other text of ``texts``, as no partner can share more."""
    kind = texts.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("s", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [x.view(np.int64) for x in shingle_sets(*text_bytes(batch.column(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    rows = texts.select("id", "body").mapInArrow(run, schema).select("id", F.explode("s").alias("s"))
    alone = rows.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    return texts.select("id", "n", "bands").join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"), "bands")


def pivot_profiles(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``p, id, of, within, miss``: a pivot's number of shingles, how many of them a text has, and in which of the parts that their
    hashes make it lacks one, as bits."""
    kind = texts.schema["id"].dataType
    left = texts.select(F.col("id").alias("p"), F.col("body").alias("p_body"))
    rows = pairs.join(texts.select("id", "body"), "id").join(left, "p").select("p", "id", "body", "p_body")
    fields = [("p", kind), ("id", kind), ("of", T.LongType()), ("within", T.LongType()), *[(f"miss{i}", T.LongType()) for i in range(PARTS // 64)]]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, counts, bits = whole.slice(at, 64), [], []
                sets = list(shingle_sets(*text_bytes(batch.column(2))))
                # rows come by pivot: its set is made once for all of them, and never at the same time as the others'
                of = batch.column(0).dictionary_encode()
                first = np.unique(np.asarray(of.indices), return_index=True)[1]
                pivots = list(shingle_sets(*text_bytes(batch.column(3).take(pa.array(first)))))
                for x, y in zip(sets, (pivots[i] for i in np.asarray(of.indices))):
                    gone = np.setdiff1d(y, x, assume_unique=True)
                    flags = np.zeros(PARTS, np.uint8)
                    flags[(gone % np.uint64(PARTS)).astype(np.int64)] = 1
                    counts.append((len(y), len(y) - len(gone)))
                    bits.append(np.packbits(flags).view(np.int64))
                columns = [*np.array(counts, np.int64).reshape(-1, 2).T, *np.array(bits, np.int64).reshape(-1, PARTS // 64).T]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in columns]], names=[f for f, _ in fields])

    return rows.mapInArrow(run, schema)


def _link(members: DataFrame, texts: DataFrame, percent: int, kind: str) -> DataFrame:
    """Components of the texts that share a cell: first against the pivots of the cells, then what is still apart among each other.

    Of two texts still apart either may share only shingles that others have at all, and of the cell's pivot at least one less for every
    part in which one of them lacks any. Edits of one original are mostly their own and at places of their own, so these two bounds leave few
    of the pairs of a large group, inside the join and before any text is moved.
    """
    spark = members.sparkSession
    best = members.groupBy("cell").agg(F.max(F.struct("degree", "id", "n")).alias("p"))
    best = materialise(best.select("cell", F.col("p.id").alias("a"), F.col("p.n").alias("m")))
    ratio = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = members.join(best, "cell").where("a <> id").where(ratio).select("a", F.col("id").alias("b")).distinct()
    tested = materialise(pairs)
    links = materialise(confirm(tested, texts, percent))
    none = spark.createDataFrame([], f"id {kind}, label {kind}")
    labels = components(links) if not links.isEmpty() else none
    rows = members.select("cell", "id", "n").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = materialise(rows.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cell"))
    rows = materialise(rows.join(split, "cell"))
    most = materialise(shareable(texts.join(rows.select("id").distinct(), "id", "left_semi")))
    rows = materialise(rows.join(most, "id").join(best.select("cell", F.col("a").alias("p")), "cell"))
    profiles = materialise(pivot_profiles(materialise(rows.select("p", "id").distinct()), texts))
    rows = materialise(rows.join(profiles, ["p", "id"]).withColumn("rest", F.col("most") - F.col("within")))
    miss = [f"miss{i}" for i in range(PARTS // 64)]
    other = rows.select("cell", *[F.col(c).alias(f"{c}_b") for c in ("n", "label", "most", "bands", "within", "rest", *miss)], F.col("id").alias("b"))
    lacking = sum((F.bit_count(F.col(c).bitwiseOR(F.col(f"{c}_b"))) for c in miss), F.lit(0))
    common = F.least("within", "within_b", F.col("of") - lacking) + F.least("rest", "rest_b")
    common = F.least("most", "most_b", common)
    possible = (F.col("label") < F.col("label_b")) & ((100 + percent) * common >= percent * (F.col("n") + F.col("n_b")))
    # a pair that shares several cells is made in the first of them only
    shared = F.filter(F.zip_with("bands", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    possible = possible & (F.get(shared, 0) == F.col("cell"))
    one = rows.withColumnRenamed("cell", "cell_a")
    pairs = one.join(other, (F.col("cell_a") == F.col("cell")) & possible).select(F.col("id").alias("a"), "b").distinct()
    done = tested.union(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = materialise(pairs.join(done, ["a", "b"], "left_anti"))
    more = materialise(confirm(pairs, texts, percent))
    return labels if more.isEmpty() else components(links.union(more))


def keep_one(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns; of rows that share a key one stays."""
    found = near_duplicates(docs.select(key, text), percent, key, text)
    kept = found.where("kept AND " + f"`{key}` IS NOT NULL").select(F.col(key).alias("__kept")).distinct()
    rows = docs.join(kept, F.col(key) == F.col("__kept")).drop("__kept").dropDuplicates([key])
    return rows.select(*[f"`{c}`" for c in docs.columns]).union(docs.where(F.col(key).isNull()))
