"""Hard negatives by an STR-packed R-tree over whole-number vectors.

The rows are packed by sort-tile-recursive order: Spark cuts them at quantiles of the widest coordinates into tiles of about equal size,
and every tile packs its rows into leaves the same way. A leaf's minimum bounding box bounds the inner product with an anchor, coordinate
by coordinate: the least and the greatest of ``a * low`` and ``a * high``, summed. A query walks the boxes of a tile best first, by the
upper bound, and leaves out boxes outside its window of scores, and boxes strictly below the k-th score found so far (or equal to it with
larger ids only). An anchor first asks the tile with the best bound; what it finds there keeps most other tiles' boxes shut.

Tiles are cut at coordinate + a fraction from the row number's hash, so that one vector in a third of the rows spreads over many tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import materialise, unit_hash
from lodestat.llm.vectors import dot, matrix, usable, whole_components, widest

TILE_ROWS, MAX_TILES, LEAF = 2048, 4096, 64
#: Coordinates that Spark cuts; a tile is cut further by its own widest ones.
CUT_AXES = 3
#: Anchors that one task holds against a tile.
ANCHORS = 1 << 16
LEAST, MOST = -(1 << 62), 1 << 62


def cut_tiles(rows: DataFrame, width: int, n: int) -> DataFrame:
    """``rows`` with a column ``tile``: quantile cuts of the coordinates with the largest variance, one after the other."""
    per_axis = round(min(max(-(-n // TILE_ROWS), 1), MAX_TILES) ** (1 / CUT_AXES) + 0.4999)
    out = rows.withColumn("tile", F.lit(0))
    if per_axis < 2:
        return out
    at = lambda i: F.coalesce(F.get("v", i), F.lit(0)).cast("double")
    spread = rows.agg(*[F.variance(at(i)).alias(str(i)) for i in range(width)]).first()
    axes = sorted(range(width), key=lambda i: (-(spread[i] or 0.0), i))[:CUT_AXES]
    shares = [i / per_axis for i in range(1, per_axis)]
    for axis in axes:
        where = at(axis) + unit_hash(F.col("row"), seed=f"tile:{axis}")
        cuts = out.groupBy(F.col("tile").alias("of")).agg(F.percentile_approx(where, shares, 1000).alias("cuts"))
        cuts = F.broadcast(materialise(cuts))  # at most MAX_TILES rows
        below = F.size(F.filter("cuts", lambda c: c < where))
        out = out.join(cuts, F.col("tile") == F.col("of")).withColumn("tile", F.col("tile") * per_axis + below).drop("of", "cuts")
    return out


def pack_order(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows: slabs along the widest coordinate, each slab along the next, down to leaves."""
    spread = v.astype(np.float64).var(axis=0)
    axes = np.argsort(-spread, kind="stable")

    def split(index: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(index) // leaf)
        if leaves <= 1 or depth >= len(axes):
            return [index]
        order = index[np.argsort(v[index, axes[depth]], kind="stable")]
        slabs = min(leaves, max(2, round(leaves ** (1 / 4))))
        rows = -(-leaves // slabs) * leaf
        return [x for at in range(0, len(order), rows) for x in split(order[at : at + rows], depth + 1)]

    return np.concatenate(split(np.arange(len(v)), 0)) if len(v) else np.arange(0)


class Anchors(NamedTuple):
    n: np.ndarray
    row: np.ndarray
    label: np.ndarray
    v: np.ndarray


class Windows(NamedTuple):
    """Ranges of scores: the anchor's number, bounds, and the k-th score and id known so far."""

    who: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray
    kth_id: np.ndarray


class Tree:
    """Leaves of one tile: rows in packed order and their boxes."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = pack_order(v)
        self.rows, self.ids, self.labels, self.v = rows[order], ids[order], labels[order], v[order]
        starts = np.arange(0, len(ids), LEAF)
        self.low, self.high = np.minimum.reduceat(self.v, starts, axis=0), np.maximum.reduceat(self.v, starts, axis=0)
        self.least_id = np.minimum.reduceat(self.ids, starts)

    def search(self, anchors: Anchors, windows: Windows, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """The ``k`` best rows of the tile per window by score, then id, as arrays ``(window number, score, id)``.

        ``same``: whether the label must equal the anchor's or differ from it. An anchor doesn't meet its own row.
        """
        who, kth, kth_id = windows.who, windows.kth.copy(), windows.kth_id.copy()
        lower, upper = box_bounds(anchors.v, self.low, self.high)
        queue = np.argsort(-upper, axis=1, kind="stable")
        held = [np.zeros(0, np.int64)] * 3
        open_ = np.arange(len(who))
        for turn in range(upper.shape[1]):
            top = upper[who[open_], queue[who[open_], turn]]
            open_ = open_[(top >= windows.low[open_]) & (top >= kth[open_])]  # later boxes have no greater bound
            if not len(open_):
                break
            box = queue[who[open_], turn]
            up = upper[who[open_], box]
            look = (lower[who[open_], box] <= windows.high[open_]) & ((up > kth[open_]) | (self.least_id[box] < kth_id[open_]))
            found = list(self.meet(open_[look], box[look], anchors, windows, kth, kth_id, same))
            if not found:
                continue
            held = best_of(*[np.concatenate([h, *f]) for h, f in zip(held, zip(*found))], k)
            q, s, i = held
            first = np.flatnonzero(q[k - 1 :] == q[: max(len(q) - k + 1, 0)])
            last = first + k - 1
            last = last[(s[last] > kth[q[last]]) | ((s[last] == kth[q[last]]) & (i[last] < kth_id[q[last]]))]
            kth[q[last]], kth_id[q[last]] = s[last], i[last]
        return held

    def meet(self, asked: np.ndarray, boxes: np.ndarray, anchors: Anchors, windows: Windows, kth: np.ndarray, kth_id: np.ndarray, same: bool):
        """Rows of each asking window's box that it takes and that beat what it has, box by box; one product for all anchors at a box."""
        order = np.argsort(boxes, kind="stable")
        asked, boxes = asked[order], boxes[order]
        edges = np.append(np.flatnonzero(np.diff(boxes, prepend=-1)), len(boxes))
        for a, b in zip(edges[:-1], edges[1:]):
            cut = slice(boxes[a] * LEAF, (boxes[a] + 1) * LEAF)
            q = asked[a:b]
            mine, line = np.unique(windows.who[q], return_inverse=True)
            ids, scores = self.ids[cut], dot(anchors.v[mine], self.v[cut])
            fits = (anchors.label[mine][:, None] == self.labels[cut][None, :]) == same
            fits &= anchors.row[mine][:, None] != self.rows[cut][None, :]
            s = scores[line]
            good = fits[line] & (s >= windows.low[q][:, None]) & (s <= windows.high[q][:, None])
            good &= (s > kth[q][:, None]) | ((s == kth[q][:, None]) & (ids[None, :] < kth_id[q][:, None]))
            r, c = np.nonzero(good)
            if len(r):
                yield q[r], s[r, c], ids[c]


def box_bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return dot(up, low) + dot(down, high), dot(up, high) + dot(down, low)


def best_of(q: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` per query by score, then id, sorted that way."""
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], s[keep], i[keep]


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)


TILE = "tile int, rows array<long>, ids array<long>, labels array<long>, v array<long>, low array<long>, high array<long>"


def pack_tiles(rows: DataFrame, width: int) -> DataFrame:
    """One row per tile with its box; a tile is a bounded share of all rows."""

    def run(table: pa.Table) -> pa.Table:
        v = matrix(one_array(table.column("v")), width)
        columns = [*[np.asarray(table.column(c)) for c in ("row", "id", "label")], v.ravel(), v.min(axis=0), v.max(axis=0)]
        wrapped = [pa.array([x], pa.list_(pa.int64())) for x in columns]
        return pa.table([pa.array([table.column("tile")[0].as_py()], pa.int32()), *wrapped], names=["tile", "rows", "ids", "labels", "v", "low", "high"])

    return rows.select("tile", "row", "id", "label", "v").groupBy("tile").applyInArrow(run, TILE)


def tile_boxes(tiles: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers and boxes of all tiles: at most ``MAX_TILES`` times two vectors."""
    found = tiles.select("tile", "low", "high").collect()
    pick = lambda c: np.array([r[c] for r in found], np.int64).reshape(len(found), width)
    return np.array([r["tile"] for r in found], np.int64), pick("low"), pick("high")


#: A question: its number, the anchor, and windows with the k-th score and id known so far.
WINDOW = ["query", "low", "high", "kth", "kth_id"]
ASK = f"n long, row long, label long, v array<long>, w array<struct<{','.join(c + ':bigint' for c in WINDOW)}>>"


def question_arrays(table: pa.Table | pa.RecordBatch, width: int) -> tuple[Anchors, Windows, np.ndarray]:
    """Anchors, their windows, and the ``query`` of each window."""
    whole = lambda c: one_array(table.column(c)) if isinstance(table, pa.Table) else table.column(c)
    n, row, label = (np.asarray(whole(c)) for c in ("n", "row", "label"))
    lists = whole("w")
    who = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    query, *limits = (np.asarray(lists.flatten().field(i)) for i in range(len(WINDOW)))
    return Anchors(n, row, label, matrix(whole("v"), width)), Windows(who, *limits), query


def route(asks: DataFrame, boxes: tuple, width: int, best_only: bool) -> DataFrame:
    """``asks`` once per tile that may hold an answer: the one with the best bound, or all others that some window leaves open."""
    shared = asks.sparkSession.sparkContext.broadcast(boxes)
    names = ["n", "row", "label", "v", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, low, high = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                anchors, windows, _ = question_arrays(batch, width)
                lower, upper = box_bounds(anchors.v, low, high)
                best = upper.argmax(axis=1)
                open_ = np.zeros(upper.shape, bool)
                if best_only:
                    open_[np.arange(len(best)), best] = True
                else:
                    up, who = upper[windows.who], windows.who
                    some = (up >= windows.low[:, None]) & (up >= windows.kth[:, None]) & (lower[who] <= windows.high[:, None])
                    np.logical_or.at(open_, who, some)
                    open_[np.arange(len(best)), best] = False
                row, col = np.nonzero(open_)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in names], pa.array(tiles[col], pa.int32())], names=[*names, "tile"])

    return asks.select(*names).mapInArrow(run, f"{ASK}, tile int")


def answer(routed: DataFrame, tiles: DataFrame, width: int, k: int, same: bool, n_asks: int) -> DataFrame:
    """``n, query, score, id``: the ``k`` best rows of each tile for the windows routed to it."""
    parts = max(1, -(-n_asks // ANCHORS))
    spread = tiles.drop("low", "high").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = routed.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int"))

    def run(questions: pa.Table, tile: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if questions.num_rows and tile.num_rows:
            rows, ids, labels, flat = (np.asarray(one_array(tile.column(c)).flatten()) for c in ("rows", "ids", "labels", "v"))
            tree = Tree(rows, ids, labels, flat.reshape(-1, width))
            for at in range(0, questions.num_rows, 4096):  # bounds and queues of so many anchors at a time
                anchors, windows, query = question_arrays(questions.slice(at, 4096), width)
                q, s, i = tree.search(anchors, windows, k, same)
                out.append((anchors.n[windows.who[q]], query[q], s, i))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=["n", "query", "score", "id"])

    asked, spread = asked.groupBy("tile", "salt"), spread.groupBy("tile", "salt")
    return asked.cogroup(spread).applyInArrow(run, "n long, query long, score long, id long")


def search(asks: DataFrame, tiles: DataFrame, boxes: tuple, width: int, k: int, same: bool, n_asks: int) -> DataFrame:
    """``n, query, found``: up to ``k`` structs ``(score, id)`` per window in order, over all tiles. ``asks``: ``n, row, label, v, w``."""

    def merge(parts: DataFrame) -> DataFrame:
        order = F.expr("sort_array(collect_list(struct(-score AS down, id)))")  # at most k rows of each tile
        top = F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["down"]).alias("score"), x["id"].alias("id")))
        return parts.groupBy("n", "query").agg(top.alias("found"))

    first = materialise(merge(answer(route(asks, boxes, width, True), tiles, width, k, same, n_asks)))
    last = F.get("found", k - 1)
    known = first.where(F.size("found") == k).select("n", F.struct("query", last["score"].alias("kth"), last["id"].alias("kth_id")).alias("k"))
    held = asks.join(known.groupBy("n").agg(F.collect_list("k").alias("known")), "n", "left")

    def bound(w: Column) -> Column:
        hit = F.get(F.filter("known", lambda x: x["query"] == w["query"]), F.lit(0))
        return F.struct(w["query"].alias("query"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(hit["kth"], F.lit(LEAST)).alias("kth"), F.coalesce(hit["kth_id"], F.lit(MOST)).alias("kth_id"))

    bounded = materialise(held.select("n", "row", "label", "v", F.transform("w", bound).alias("w")))
    rest = answer(route(bounded, boxes, width, False), tiles, width, k, same, n_asks)
    both = first.select("n", "query", F.explode("found").alias("f")).select("n", "query", "f.*").unionByName(rest)
    return materialise(merge(both))


def hard_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for every anchor row and each of its ``positives``
    best other rows of the same label, the ``negatives`` best rows of another label whose score is ``low`` to ``high`` per cent of it.

    Scores are inner products of floor(256 * x), ties go to the smaller key. Rows with a missing key, label or vector, or with a component
    that is missing, infinite or not a number take no part. A row meets every row but itself: a repeated row is another row, and a
    repeated anchor gives its answers once for each. Shorter vectors are padded with zeros. Labels are whole numbers. Other columns are
    ignored; an empty table, or one without anchors, gives no rows. Scores must fit in 62 bits.
    """
    of = F.col(label) if isinstance(label, str) else label
    rows = df.where(usable(vector) & F.col(key).isNotNull() & of.isNotNull())
    whole = rows.select(F.col(key).cast("long").alias("id"), of.cast("long").alias("label"), whole_components(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = materialise(whole.withColumn("row", F.monotonically_increasing_id()))
    kind = df.schema[key].dataType.simpleString()
    size = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    width = max(widest(rows, "v"), 1)
    if not size[1]:
        names = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], names)
    tiles = materialise(pack_tiles(cut_tiles(rows, width, size[0]), width))
    boxes = tile_boxes(tiles, width)
    anchors = rows.where("asks").select(F.col("row").alias("n"), "row", F.col("id").alias("anchor"), "label", "v")

    def windows(of: Column, floor_: Column, ceiling: Column) -> Column:
        return F.struct(of.cast("long").alias("query"), floor_.alias("low"), ceiling.alias("high"), F.lit(LEAST).alias("kth"), F.lit(MOST).alias("kth_id"))

    every = F.array(windows(F.lit(0), F.lit(LEAST), F.lit(MOST))).alias("w")
    friends = search(anchors.select("n", "row", "label", "v", every), tiles, boxes, width, positives, True, size[1])
    friends = materialise(friends.select("n", F.posexplode("found").alias("query", "p")).select("n", "query", F.col("p.score").alias("positive_score"), F.col("p.id").alias("positive_id")))
    # low * p <= 100 * s <= high * p in whole numbers
    least = F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100")
    most = F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100")
    ranges = friends.where(least <= most).groupBy("n").agg(F.collect_list(windows(F.col("query"), least, most)).alias("w"))
    asks = materialise(anchors.join(ranges, "n").select("n", "row", "label", "v", "w"))
    foes = search(asks, tiles, boxes, width, negatives, False, size[1])
    foes = foes.select("n", "query", F.posexplode("found").alias("place", "f"))
    out = friends.join(anchors.select("n", "anchor"), "n").join(foes, ["n", "query"])
    return out.select(
        F.col("anchor").cast(kind).alias("anchor_id"), F.col("positive_id").cast(kind).alias("positive_id"), (F.col("place") + 1).cast("int").alias("rank"),
        F.col("f.id").cast(kind).alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"),
    )
