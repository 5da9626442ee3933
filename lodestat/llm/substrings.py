"""Removal of long repeated byte strings, by hashes at sampled positions.

Prefix doubling ranks every position by ever longer prefixes and drops positions as soon as they are unique. This isn't prefix doubling:
nothing is ranked. Positions are first sampled so that no repeat can be missed: of every ``LENGTH`` bytes the smallest hash of a
``GRAM``-byte string marks an anchor, the same one in every copy. All positions whose window has the same anchor are one interval of
offsets, and Spark groups and counts intervals by keys at three fixed levels:

* the anchor's own bytes: an anchor seen once drops its whole interval;
* the bytes common to all windows of an interval (a unique one drops it) and the bytes of all its windows together (a repeated one
  settles it, all copies at once), for the interval as a whole and then for cells of ``CELL`` offsets;
* the ``LENGTH`` bytes themselves, for the few cells at the edges of repeats.

Only one representative of each distinct interval goes on, so a passage in a third of all documents is a count, not a group.
Keys are 64-bit hashes, always compared together with those of the level before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.common import blocks, materialise, mix64, text_bytes, whole_text
from lodestat.llm.shingles import BYTE, powers

LENGTH, GRAM, CELL = 400, 100, 20
REACH = LENGTH - GRAM
CHUNK = 1 << 20
PLACE = np.uint64((1 << 22) - 1)


def sums(body: np.ndarray) -> np.ndarray:
    """Running polynomial hash: the hash of a slice is a difference of two sums."""
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(BYTE[body] * powers(len(body))[0], out=total[1:])
    return total


def slices(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ``body[a:b]``, alike for alike bytes wherever they stand."""
    return mix64((total[b] - total[a]) * powers(len(total))[1][a] + (b - a).astype(np.uint64))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from minima towards both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def intervals(body: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Anchor, first and last position, anchor key and key of all bytes, per interval of a block of texts."""
    n = len(body)
    if n < LENGTH:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    total = sums(body)
    at = np.arange(n - GRAM + 1)
    grams = slices(total, at, at + GRAM)
    least = window_minimum((grams & ~PLACE) | at.astype(np.uint64), REACH + 1)
    whole = np.zeros(n + 1, np.int32)
    lengths = ends - starts
    long = lengths >= LENGTH
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(whole[: len(least)]) > 0)
    if not len(valid):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    anchor = (least[valid] & PLACE).astype(np.int64)
    edge = np.flatnonzero(np.diff(anchor)) + 1
    first, last = valid[np.append(0, edge)], valid[np.append(edge - 1, len(valid) - 1)]
    mark = anchor[np.append(0, edge)]
    return [mark, first, last, grams[mark], outer_key(slices(total, first, last + LENGTH), mark - first, mark - last)]


def outer_key(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of an interval's bytes together with where the anchor stands in it."""
    return mix64(hashes + (left * 512 + right + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_intervals(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(text number, anchor, first, last, gram, outer)`` arrays for the texts of a batch; long texts go chunk by chunk."""
    for start, stop in blocks(offsets, CHUNK):
        base = offsets[start]
        if stop - start > 1 or offsets[stop] - base <= 2 * CHUNK:
            edges = offsets[start : stop + 1] - base
            found = intervals(body[base : offsets[stop]], edges[1:], edges[:-1])
            owner = np.searchsorted(edges, found[0], side="right") - 1
            yield owner + start, *[x - edges[owner] for x in found[:3]], *found[3:]
            continue
        text, held = body[base : offsets[stop]], None
        for at in range(0, len(text), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            found = intervals(part, np.array([len(part)]), np.array([0]))
            rows = [found[0] + at, found[1] + at, found[2] + at, found[3], found[4]]
            if held is not None and len(rows[0]) and rows[0][0] == held[0][0]:  # one interval across two chunks
                rows[1][0] = held[1][0]
                piece = text[rows[1][0] : rows[2][0] + LENGTH]
                key = slices(sums(piece), np.array([0]), np.array([len(piece)]))
                rows[4][0] = outer_key(key, rows[0][:1] - rows[1][:1], rows[0][:1] - rows[2][:1])[0]
                held = None
            if held is not None:
                yield np.full(1, start), *held
            held = None
            if len(rows[0]):
                held = [x[-1:].copy() for x in rows]
                yield np.full(len(rows[0]) - 1, start), *[x[:-1] for x in rows]
        if held is not None:
            yield np.full(1, start), *held


ROW = "id long, h long, anchor int, lo int, hi int, gram long, whole long"


def mark_intervals(source: DataFrame) -> DataFrame:
    """Intervals of ``source`` (``id, h, body``); ``lo`` and ``hi`` are offsets from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(i)) for i in (0, 1))
            for owner, mark, first, last, gram, whole in text_intervals(*text_bytes(batch.column(2))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[owner], hashes[owner], mark.astype(np.int32), (first - mark).astype(np.int32), (last - mark).astype(np.int32), gram.view(np.int64), whole.view(np.int64))],
                    names=["id", "h", "anchor", "lo", "hi", "gram", "whole"],
                )

    return source.mapInArrow(run, ROW)


def contexts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted anchor, all windows of its interval: ``left`` of them stand before the anchor."""
    asked = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "lo", "hi", "gram")).alias("asked"))
    rows = source.join(asked, ["id", "h"]).select("id", "h", "body", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_bytes(batch.column(2))
            for i in range(batch.num_rows):
                text = body[offsets[i] : offsets[i + 1]]
                asked = batch.column(3)[i].as_py()
                begins = [max(0, x["anchor"] - REACH) for x in asked]
                made = [text[b : x["anchor"] + LENGTH].tobytes() for b, x in zip(begins, asked)]
                n = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                        *[pa.array([x[c] for x in asked], pa.int32()) for c in ("anchor", "lo", "hi")], pa.array([x["gram"] for x in asked], pa.int64()),
                        pa.array([x["anchor"] - b for b, x in zip(begins, asked)], pa.int32()), pa.array(made, pa.binary()),
                    ],
                    names=["id", "h", "anchor", "lo", "hi", "gram", "left", "bytes"],
                )

    return rows.mapInArrow(run, "id long, h long, anchor int, lo int, hi int, gram long, left int, bytes binary")


def cell_keys(around: DataFrame) -> DataFrame:
    """For every cell of offsets that an interval touches: key of the bytes common to its windows and key of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "anchor", "gram", "cell", "lo", "hi", "inner", "whole"]
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (2, 3, 4, 6)]
            out: list[list] = [[] for _ in range(7)]
            for i, (anchor, lo, hi, left) in enumerate(zip(*cols)):
                body = np.frombuffer(batch.column(7)[i].as_py(), np.uint8)
                cells = np.arange((lo + REACH) // CELL, (hi + REACH) // CELL + 1)
                low, high = cells * CELL - REACH, np.minimum(cells * CELL - REACH + CELL - 1, 0)
                total = sums(body)
                inner = slices(total, left + high, left + low + LENGTH)
                a, b = np.maximum(low, -left), np.minimum(high, len(body) - left - LENGTH)
                whole = outer_key(slices(total, left + a, left + b + LENGTH), -a, -b)
                for k, x in enumerate((np.full(len(cells), i), cells, a, b, inner.view(np.int64), whole.view(np.int64))):
                    out[k].append(x)
            if not out[0]:
                continue
            row, cells, a, b, inner, whole = (np.concatenate(x) for x in out[:6])
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), batch.column(5).take(pick),
                 *[pa.array(x.astype(np.int32)) for x in (cells, a, b)], pa.array(inner), pa.array(whole)], names=names,
            )

    return around.mapInArrow(run, "id long, h long, anchor int, gram long, cell int, lo int, hi int, inner long, whole long")


def position_keys(around: DataFrame, cells: DataFrame) -> DataFrame:
    """Key of the ``LENGTH`` bytes at every offset of the given cells."""
    asked = cells.groupBy("id", "h", "anchor").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
    rows = around.join(asked, ["id", "h", "anchor"]).select("id", "h", "anchor", "gram", "left", "bytes", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, offset, key = [], [], []
            for i in range(batch.num_rows):
                left = batch.column(4)[i].as_py()
                total = sums(np.frombuffer(batch.column(5)[i].as_py(), np.uint8))
                at = np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in batch.column(6)[i].as_py()])
                owner.append(np.full(len(at), i))
                offset.append(at)
                key.append(slices(total, left + at, left + at + LENGTH))
            if not owner:
                continue
            pick = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pick) for c in range(4)], pa.array(np.concatenate(offset).astype(np.int32)), pa.array(np.concatenate(key).view(np.int64))],
                names=["id", "h", "anchor", "gram", "offset", "key"],
            )

    return rows.mapInArrow(run, "id long, h long, anchor int, gram long, offset int, key long")


def split_groups(rows: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Intervals of ``rows`` that are settled, and one representative of each distinct interval in groups that hold several."""
    kinds = rows.groupBy(*group, "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "anchor", "lo", "hi")).alias("one"))
    kinds = materialise(kinds)
    settled = rows.join(kinds.where("n > 1").select(*group, "whole"), [*group, "whole"], "left_semi")
    settled = settled.select("id", "h", (F.col("anchor") + F.col("lo")).alias("a"), (F.col("anchor") + F.col("hi") + LENGTH).alias("b"))
    several = materialise(kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*group))
    return settled, kinds.join(several, group, "left_semi").select(*group, "one.*")


def repeated_intervals(source: DataFrame) -> DataFrame:
    """``id, h, a, b``: byte ranges covered by repeated strings of ``LENGTH`` bytes, unmerged."""
    marks = mark_intervals(source)
    # written first, so that the join reads both sides by exchanges of its own, whose hot keys Spark can split
    many = materialise(marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    rows = materialise(marks.join(many, "gram", "left_semi"))
    settled, open_ = split_groups(rows, ["gram"])
    around = materialise(contexts(source, open_))
    cells = cell_keys(around)
    group = ["gram", "cell", "inner"]
    again = materialise(cells.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group))
    cells = materialise(cells.join(again, group, "left_semi"))
    cell_settled, cell_open = split_groups(cells, group)
    places = materialise(position_keys(around, cell_open))
    keys = ["gram", "offset", "key"]
    twice = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    single = places.join(twice, keys, "left_semi")
    single = single.select("id", "h", (F.col("anchor") + F.col("offset")).alias("a"), (F.col("anchor") + F.col("offset") + LENGTH).alias("b"))
    return settled.union(cell_settled).union(single)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the remaining bytes) per row.

    Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else, in the same text or another, is removed; strings
    are judged on the input. Missing texts are empty; texts shorter than ``LENGTH`` lose nothing; repeated rows lose everything that is
    long enough. Other columns are ignored; an empty table gives no rows. Keys are whole numbers or missing.
    """
    kind = docs.schema[key].dataType
    body = whole_text(text)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(body).alias("h"), F.col(key).alias("own"), body.alias("body"))
    found = repeated_intervals(source.select("id", "h", "body").where(F.octet_length("body") >= LENGTH))
    found = found.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    rows = source.join(found, ["id", "h"], "left").select("own", "body", "ranges")
    schema = T.StructType([
        T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows, bodies = [], []
            for i in range(batch.num_rows):
                text_ = data[offsets[i] : offsets[i + 1]]
                ranges = batch.column(2)[i].values if batch.column(2)[i].is_valid else None
                kept, spans = text_.tobytes(), 0
                if ranges is not None and len(ranges):
                    change = np.zeros(len(text_) + 1, np.int64)
                    np.add.at(change, np.asarray(ranges.field("a")), 1)
                    np.add.at(change, np.asarray(ranges.field("b")), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = text_[~gone].tobytes()
                bodies.append(kept)
                rows.append((len(text_), len(text_) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            made = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in made[:3]], pa.array(made[3], pa.string()), pa.array(bodies, pa.binary())], names=[f.name for f in schema]
            )

    return rows.mapInArrow(run, schema)
