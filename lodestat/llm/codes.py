"""Product codes of vectors, entries found by Orchard search.

Every part of a vector is replaced by the index of its nearest codebook entry. The search holds, for every entry, the list of all entries
by distance from it. It starts at some entry and walks that entry's list; whenever a listed entry is nearer to the point it becomes the
current one and its list is walked from the start, with entries already tried marked. Once the listed entry is more than twice the
point's distance away from the current entry no later one can be nearer, by the triangle inequality. Whole numbers throughout, so sums
don't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import materialise
from lodestat.llm.vectors import matrix, usable, whole_components, widest

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Points searched at a time.
BLOCK = 1 << 15


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry, all entries by squared distance from it, and those distances."""
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, axis=1)


def orchard(points: np.ndarray, entries: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties: lowest) and the squared distance per point, and how many distances were computed.

    All points walk side by side: in each step every unfinished point looks at the next entry of its current list.
    """
    order, gaps = neighbour_lists(entries) if lists is None else lists
    n, k = len(points), len(entries)
    by_first = np.argsort(entries[:, 0], kind="stable")
    start = np.minimum(np.searchsorted(entries[by_first, 0], points[:, 0]), k - 1)
    best = by_first[start]
    nearest = ((points - entries[best]) ** 2).sum(axis=1)
    tried = np.zeros((n, k), bool)
    tried[np.arange(n), best] = True
    place = np.zeros(n, np.int64)
    walking, computed = np.arange(n), n
    while len(walking):
        now, at = best[walking], place[walking]
        go = gaps[now, at] <= 4 * nearest[walking]
        walking, now, at = walking[go], now[go], at[go]
        other = order[now, at]
        place[walking] = at + 1
        fresh = ~tried[walking, other]
        rows, other = walking[fresh], other[fresh]
        tried[rows, other] = True
        found = ((points[rows] - entries[other]) ** 2).sum(axis=1)
        computed += len(rows)
        better = (found < nearest[rows]) | ((found == nearest[rows]) & (other < best[rows]))
        rows = rows[better]
        best[rows], nearest[rows], place[rows] = other[better], found[better], 0
        walking = walking[place[walking] < k]
    return best, nearest, computed


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, one column per part. ``books``: parts x entries x components."""
    parts, _, wide = books.shape
    codes, errors = (np.zeros((len(vectors), parts), np.int64) for _ in range(2))
    for p in range(parts):
        lists = neighbour_lists(books[p])
        for at in range(0, len(vectors), BLOCK):
            cut = slice(at, at + BLOCK)
            codes[cut, p], errors[cut, p], _ = orchard(vectors[cut, p * wide : (p + 1) * wide], books[p], lists)
    return codes, errors


def first_books(rows: DataFrame, width: int, key: str, parts: int, entries: int) -> np.ndarray:
    """The parts of the ``entries`` rows with the smallest keys; a bounded number of rows for any table."""
    head = rows.orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(head), width), np.int64)
    for i, r in enumerate(head):
        start[i, : len(r["v"])] = r["v"]
    return np.ascontiguousarray(start.reshape(len(head), parts, width // parts).transpose(1, 0, 2))


def refine(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; an unused one stays."""
    parts, k, wide = books.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total, count = np.zeros((parts * k, wide), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            vectors = matrix(batch.column(0), parts * wide)
            codes, _ = assign(vectors, held)
            cell = codes + np.arange(parts) * k
            np.add.at(total, cell.ravel(), vectors.reshape(-1, wide))
            count += np.bincount(cell.ravel(), minlength=parts * k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cell", "n", "s"])

    found = rows.select("v").mapInArrow(run, "cell long, n long, s array<long>").groupBy("cell")
    found = found.agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(wide)]).collect()
    out = books.reshape(parts * k, wide).copy()
    for r in found:
        out[r["cell"]] = [r[f"s{i}"] // r["n"] for i in range(wide)]
    shared.unpersist()
    return out.reshape(books.shape)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def product_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` per row with a usable vector.

    Rows whose vector is missing or holds a missing, infinite or not-a-number component are left out. Shorter vectors, and all if the
    longest isn't a multiple of ``parts``, are padded with zeros. Repeated rows each give a row; of rows that share a key those with the
    smaller vector come first as initial entries, missing keys come last. Fewer rows than ``entries`` give fewer entries. A code is the
    entry's index in each part, two hex digits (more entries than 256: as many digits as the largest needs). ``label_error`` sums
    ``error`` over equal labels, missing ones together. Other columns are ignored; an empty table gives no rows. Components times 256 and
    their squared distances must fit in 64 bits.
    """
    rows = df.where(usable(vector)).select(F.col(key).alias("id"), F.col(label).alias("label"), whole_components(vector).alias("v"))
    rows = materialise(rows)
    width = -(-max(widest(rows, "v"), 1) // parts) * parts
    books = first_books(rows, width, "id", parts, entries)
    kind = df.schema[key].dataType.simpleString()
    named = df.schema[label].dataType.simpleString()
    if not books.shape[1]:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = reduce(lambda held, _: refine(rows, held), range(rounds), books)
    shared = df.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(matrix(batch.column(2), width), shared.value)
            made = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    coded = materialise(rows.mapInArrow(run, f"id {kind}, label {named}, code string, error long"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
