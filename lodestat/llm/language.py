"""Language model scores from a log-frequency Bloom filter of word pairs.

Spark counts words and pairs of neighbouring words in the training texts. A pair seen at least ``MIN_PAIRS`` times is put into a Bloom
filter once per level of its quantised count, 1 to floor(log2 count): a reader probes level after level until one is missing, so a
count is never read too low. The filter is made of blocks of fixed size, each built by one group; it is broadcast in shards of at most
``SHARD_BYTES``, one pass over the texts per shard, so that neither memory nor the rate of false hits depends on the corpus' size.

Words have exact counts: the ``HEAD_WORDS`` most frequent ones are broadcast, rarer words of a text are joined. A token w after u has

    p(w | u) = (q(u, w) + MASS * p(w)) / (K(u) + MASS),    p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with q the quantised count of the pair and K(u) the sum of q over the pairs that start with u. Its logarithm is a sum of a term of w, a
term of u and, for the few pairs in the filter, one more term; so each part is summed where its counts are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import BLOCK_BYTES, blocks, materialise, mix64, splitmix, text_bytes, whole_text
from lodestat.llm.shingles import long_words, word_hashes

#: Pairs seen less often aren't part of the model. Pseudo-count of the words' distribution in each context; of an unseen word.
MIN_PAIRS, MASS, ADD = 2, 2.0, 0.1
BITS, PROBES = 16, 8
BLOCK, SHARD_BYTES = 1 << 16, 64 << 20
HEAD_WORDS = 1 << 20
#: Distinct words and pairs that a counting task holds before it hands them on.
HELD = 1 << 21
BEGIN, END = (int(x) for x in splitmix(2, 29).view(np.int64))
SEED = splitmix(64 * PROBES, 31).reshape(64, PROBES)
#: A pair's key: the leading bits of the first word's hash, then bits of both.
CONTEXT = 28
RARE_BINS = 1 << 16


def token_blocks(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First text, token hashes, owners (from 0) and preceding tokens for runs of whole texts; each text ends with ``END``."""
    for start, stop in blocks(offsets):
        part, n = body[offsets[start] : offsets[stop]], stop - start
        if n == 1 and len(part) > BLOCK_BYTES:
            words = long_words(part)
            owner = np.zeros(len(words), np.int64)
        else:
            words, owner = word_hashes(part, offsets[start:stop] - offsets[start])
        sizes = np.bincount(owner, minlength=n) + 1
        ends = np.cumsum(sizes) - 1
        tokens = np.full(len(words) + n, END, np.int64)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words.view(np.int64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[ends - sizes + 1] = BEGIN
        yield start, tokens, np.repeat(np.arange(n), sizes), before


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    a, b = before.view(np.uint64), tokens.view(np.uint64)
    low = mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b)) >> np.uint64(64 - CONTEXT)
    return ((a >> np.uint64(CONTEXT) << np.uint64(CONTEXT)) | low).view(np.int64)


def count_tokens(texts: DataFrame) -> DataFrame:
    """``pair`` (false: a word), ``h`` and ``c``: how often each word and each kept pair stands in the column ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pair: bool, parts: list) -> Iterator[pa.RecordBatch]:
            if parts:
                h, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), pair)), pa.array(h), pa.array(c)], names=["pair", "h", "c"])

        held: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for _, tokens, _, before in token_blocks(*text_bytes(batch.column(0))):
                for pair, found in ((False, tokens), (True, pair_keys(before, tokens))):
                    held[pair].append(np.unique(found, return_counts=True))
                    if sum(len(h) for h, _ in held[pair]) > HELD:
                        held[pair] = [merged(held[pair])]
                        if len(held[pair][0][0]) > HELD // 2:
                            yield from rows(pair, held[pair])
                            held[pair] = []
        for pair, parts in held.items():
            yield from rows(pair, parts)

    counts = texts.select("body").mapInArrow(run, "pair boolean, h long, c long").groupBy("pair", "h").agg(F.sum("c").alias("c"))
    return counts.where(~F.col("pair") | (F.col("c") >= MIN_PAIRS))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(h)).astype(np.int64)


def level_value(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of 2^level .. 2^(level + 1) - 1."""
    return 1.5 * np.exp2(level) - 0.5


def block_of(h: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix64(h.view(np.uint64)) >> np.uint64(32)).astype(np.int64) * n_blocks >> 32


def bit_place(h: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    """Bit within its block of a key's ``probe`` at a level."""
    return (mix64((h.view(np.uint64) ^ SEED[level, probe]) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(BLOCK * 8 - 1)).astype(np.int64)


def build_filter(pairs: DataFrame, n_blocks: int) -> DataFrame:
    """``block, bits``: each block of the filter built from the pairs that fall into it."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(block_of(h, n_blocks)), *batch.columns], names=["block", "h", "level"])

    def fill(table: pa.Table) -> pa.Table:
        h, level = np.asarray(table.column("h")), np.asarray(table.column("level")).astype(np.int64)
        bits = np.zeros(BLOCK * 8, bool)
        for up in range(1, int(level.max()) + 1):
            high = h[level >= up]
            for probe in range(PROBES):
                bits[bit_place(high, up, probe)] = True
        return pa.table([table.column("block").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    level = F.floor(F.log2("c")).cast("int")
    named = pairs.select("h", level.alias("level")).mapInArrow(name, "block long, h long, level int")
    return named.groupBy("block").applyInArrow(fill, "block long, bits binary")


def read_counts(bits: np.ndarray, h: np.ndarray, first: int, n_blocks: int) -> np.ndarray:
    """Level of every pair (0: not there, or in another shard) by probes of level 1, 2, ... until one is missing."""
    level = np.zeros(len(h), np.int64)
    at = block_of(h, n_blocks) - first
    alive = np.flatnonzero((at >= 0) & (at < len(bits) // BLOCK))
    for up in range(1, 64):
        for probe in range(PROBES):
            place = bit_place(h[alive], up, probe)
            alive = alive[(bits[at[alive] * BLOCK + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
        if not len(alive):
            break
        level[alive] = up
    return level


class Model(NamedTuple):
    """Word and pair counts of the training texts."""

    words: DataFrame  # h, c, k: count and mass K
    bits: DataFrame  # block, bits
    n_blocks: int
    tokens: int
    distinct: int
    begins: float  # K of the begin of a text
    rare: int  # words at most this frequent aren't broadcast


def fit(docs: DataFrame, text: str = "text", head_words: int = HEAD_WORDS) -> Model:
    """Counts of all rows of ``docs``, written to the shared folder."""
    counts = materialise(count_tokens(docs.select(whole_text(text).alias("body"))))
    pairs = counts.where("pair").select("h", "c")
    level = F.floor(F.log2("c"))
    mass = pairs.groupBy(F.shiftright("h", CONTEXT).alias("u")).agg(F.sum(1.5 * F.pow(F.lit(2.0), level) - 0.5).alias("k"))
    words = counts.where("NOT pair").select("h", "c").join(mass, F.shiftright("h", CONTEXT) == F.col("u"), "left")
    words = materialise(words.select("h", "c", F.coalesce("k", F.lit(0.0)).alias("k")))
    total = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    items = pairs.agg(F.sum(level)).first()[0] or 0
    begins = mass.where(F.col("u") == BEGIN >> CONTEXT).agg(F.sum("k")).first()[0] or 0.0
    n_blocks = max(1, math.ceil(items * BITS / (8 * BLOCK)))
    sizes = words.groupBy(F.least("c", F.lit(RARE_BINS)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most RARE_BINS rows
    rare, room = 0, total[1] or 0
    for r in sorted(sizes, key=lambda r: r["c"]):
        if room <= head_words:
            break
        rare, room = r["c"], room - r["n"]
    return Model(words, materialise(build_filter(pairs, n_blocks)), n_blocks, total[0] or 0, total[1] or 0, begins, rare)


def known_words(model: Model, head_words: int) -> tuple[np.ndarray, ...]:
    """Hash, count and mass of the words more frequent than ``rare``, by hash; never more than ``head_words``."""
    if model.rare >= RARE_BINS:
        table = model.words.orderBy(F.desc("c"), "h").limit(head_words).toArrow()
    else:
        table = model.words.where(F.col("c") > model.rare).toArrow()
    h, c, k = (np.asarray(table.column(x)) for x in ("h", "c", "k"))
    order = np.argsort(h)
    return h[order], c[order], k[order]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` per row, in log10; a missing text is one without words.

    ``base_score`` uses word counts alone, ``score`` the pairs as well. Equal texts get equal scores; rows that share a key or miss it are
    scored like any other. Other columns are ignored; an empty table gives no rows. After an empty training table every word is unknown.
    """
    spark = docs.sparkSession
    names = spark.sparkContext.broadcast(known_words(model, head_words))
    per_shard = max(1, shard_bytes // BLOCK)
    below = math.log10(model.tokens + ADD * (model.distinct + 1))
    unit = model.tokens + ADD * (model.distinct + 1)
    source = docs.select(F.col(key).alias("id"), whole_text(text).alias("body"))
    kind = docs.schema[key].dataType.simpleString()
    whole_table, n_blocks = not model.rare, model.n_blocks
    begin = math.log10((model.begins + MASS) / MASS)

    def one_pass(first: int) -> DataFrame:
        bits = np.zeros(min(per_shard, model.n_blocks - first) * BLOCK, np.uint8)
        for r in model.bits.where((F.col("block") >= first) & (F.col("block") < first + per_shard)).toLocalIterator():
            at = (r["block"] - first) * BLOCK
            bits[at : at + BLOCK] = np.frombuffer(r["bits"], np.uint8)
        held = spark.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, c, k = names.value
            for batch in batches:
                for start, tokens, owner, before in token_blocks(*text_bytes(batch.column(1))):
                    n = int(owner[-1]) + 1
                    kinds, back = np.unique(tokens, return_inverse=True)
                    at = np.minimum(np.searchsorted(h, kinds), max(len(h) - 1, 0))
                    there = h[at] == kinds if len(h) else np.zeros(len(kinds), bool)
                    count, mass = (np.where(there, x[at] if len(h) else 0, 0) for x in (c, k))
                    level = read_counts(held.value, pair_keys(before, tokens), first, n_blocks)
                    seen = np.flatnonzero(level)
                    settled = (there | whole_table)[back]
                    tail = []
                    if first == 0:
                        base = np.log10(count + ADD) - below
                        context = np.log10((mass + MASS) / MASS)
                        context[kinds == END] = 0.0  # nothing follows the end; the begin is a context instead
                        term = [settled, base[back], (base - context)[back], (count > 0)[back]]
                        sums = [np.bincount(owner, weights=np.where(settled, x, 0.0), minlength=n) for x in term]
                        sums[2] -= begin
                        open_ = np.flatnonzero(~settled)
                        tail.append((owner[open_], tokens[open_], np.zeros(len(open_), np.int64)))
                    else:
                        sums = [np.zeros(n)] * 4
                    pair, w = seen[settled[seen]], seen[~settled[seen]]
                    sums[2] = sums[2] + np.bincount(owner[pair], weights=gain(level[pair], count[back[pair]], unit), minlength=n)
                    tail.append((owner[w], tokens[w], level[w]))
                    lists = tail_lists(n, *[np.concatenate(x) for x in zip(*tail)])
                    pick = pa.array(np.arange(start, start + n))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pick), pa.array(np.bincount(owner, minlength=n)), pa.array(sums[3].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), batch.column(2).take(pick), lists],
                        names=["id", "n_tokens", "n_known", "base", "score", "digest", "tail"],
                    )

        rows = source.withColumn("digest", F.sha1("body") if model.n_blocks > per_shard else F.lit(""))
        schema = f"id {kind}, n_tokens long, n_known long, base double, score double, digest string, tail array<struct<h:long,level:int,tf:long>>"
        return with_rare(rows.mapInArrow(run, schema), model, unit)

    out = one_pass(0)
    for first in range(per_shard, model.n_blocks, per_shard):  # each further shard adds its pairs, once per distinct text
        more = one_pass(first).groupBy("digest").agg(F.max("score").alias("more"))
        out = materialise(out.join(more, "digest").withColumn("score", F.col("score") + F.col("more")).drop("more"))
    return out.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def gain(level: np.ndarray, count: np.ndarray, unit: float) -> np.ndarray:
    """What a pair in the filter adds to the logarithm; its count can't exceed that of its second word."""
    return np.log10(1 + np.minimum(level_value(level), count) * unit / (MASS * (count + ADD)))


def tail_lists(n: int, owner: np.ndarray, tokens: np.ndarray, level: np.ndarray) -> pa.Array:
    """Rare words per text, with the pair's level (0: the word itself) and how often."""
    order = np.lexsort((level, tokens, owner))
    rows = [x[order] for x in (owner, tokens, level)]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(order)))
    owner, tokens, level = (x[at] for x in rows)
    body = pa.StructArray.from_arrays([pa.array(tokens), pa.array(level.astype(np.int32)), pa.array(times.astype(np.int64))], names=["h", "level", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), body)


def with_rare(rows: DataFrame, model: Model, unit: float) -> DataFrame:
    """Adds the terms of words that weren't broadcast, by a join with their counts."""
    if not model.rare:
        return rows.drop("tail")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*")
    c, k = F.coalesce("c", F.lit(0)), F.coalesce("k", F.lit(0.0))
    word = F.col("level") == 0
    base = F.log10((c + ADD) / F.lit(unit))
    q = F.least(1.5 * F.pow(F.lit(2.0), F.col("level")) - 0.5, c)
    term: Column = F.when(word, base - F.log10((k + MASS) / MASS)).otherwise(F.log10(1 + q * unit / (MASS * (c + ADD))))
    joined = tail.join(model.words, "h", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.when(word & (c > 0), F.col("tf")).otherwise(0)).alias("a"), F.sum(F.when(word, F.col("tf") * base).otherwise(0.0)).alias("b"), F.sum(F.col("tf") * term).alias("s"),
    )
    out = rows.drop("tail").join(sums, "row", "left")
    plus = {"n_known": "a", "base": "b", "score": "s"}
    return out.withColumns({x: F.col(x) + F.coalesce(F.col(y), F.lit(0)) for x, y in plus.items()}).drop("row", *plus.values())


def held_out(key: Column, folds: int = 10) -> Column:
    """Whether a row isn't learnt from: crc32 of the key as text leaves no remainder. A missing key isn't learnt from either."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(True))


def score_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` with a model of the rows that aren't held out, and the column ``held_out``."""
    model = fit(docs.where(~held_out(F.col(key))), text)
    out = score(docs, model, key, text)
    return out.select(key, held_out(F.col(key)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
