"""Language model scores, hard negatives and product codes against brute force, with edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm import codes, language, negatives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that operators use for themselves
    T.StructField("id", T.StringType()), T.StructField("tile", T.StringType()), T.StructField("v", T.StringType()), T.StructField("row", T.StringType()),
])


def vector_rows(n=700, width=16, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, width))
    x = (centres[rnd.integers(0, 4, n)] + rnd.normal(size=(n, width)) * 0.7) / 4
    x[n // 2 : n // 2 + n // 3] = x[0]  # one vector in a third of the rows
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 3)) for i, v in enumerate(x)]
    rows += [rows[0], rows[5], (100, rows[7][1], 1)]  # repeated rows, a key with two vectors
    rows += [(None, rows[1][1], 1), (9001, None, 1), (9002, [], 2), (9003, rows[2][1], None), (9004, rows[3][1][:5], 0)]
    rows += [(9100, [float("nan")] * width, 0), (9200, [float("inf")] + [0.0] * (width - 1), 0), (9300, [None] + [0.1] * (width - 1), 0), (9400, [0.0] * width, 1)]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), VECTORS).repartition(5).cache()


def whole(v, width=16):
    x = [math.floor(256 * c) for c in v]
    return np.array(x + [0] * (width - len(x)), np.int64)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_negatives(rows, low=30, high=90):
    held = [(r[0], r[2], whole(r[1])) for r in rows if r[0] is not None and r[2] is not None and usable(r[1])]
    out = []
    for n, (a, label, v) in enumerate(held):
        if a % 100:
            continue
        others = sorted((-int(v @ w), i, of) for m, (i, of, w) in enumerate(held) if m != n)
        for down, positive, _ in [x for x in others if x[2] == label][:5]:
            ps = -down
            found = [(i, -d) for d, i, of in others if of != label and low * ps <= 100 * -d <= high * ps][:10]
            out += [(a, positive, k + 1, i, ps, s) for k, (i, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("tile_rows", [2048, 24])
def test_hard_negatives(vectors, monkeypatch, tile_rows):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    found = negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(vector_rows())


def test_hard_negatives_of_nothing(vectors):
    for few in (vectors.limit(0), vectors.where("vec_id % 100 = 1"), vectors.where("vec_id = 100"), vectors.where("embedding IS NULL")):
        out = negatives.hard_negatives(few, F.col("vec_id") % 100 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.hard_negatives(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_tree_opens_few_boxes():
    rnd = np.random.default_rng(1)
    v = (rnd.normal(size=(4096, 3)) * 300).astype(np.int64)
    ids = np.arange(4096)
    tree = negatives.Tree(ids, ids, np.zeros(4096, np.int64), v)
    assert sorted(tree.ids) == list(ids) and (tree.low <= tree.high).all()
    anchors = negatives.Anchors(ids[:1], np.array([-1]), np.ones(1, np.int64), np.array([[300, -200, 100]]))
    windows = negatives.Windows(np.zeros(1, np.int64), *[np.array([x]) for x in (negatives.LEAST, negatives.MOST, negatives.LEAST, negatives.MOST)])
    opened = []
    meet = tree.meet
    tree.meet = lambda asked, boxes, *a: (opened.extend(boxes), meet(asked, boxes, *a))[1]
    q, s, i = tree.search(anchors, windows, 10, same=False)
    scores = v @ anchors.v[0]
    best = sorted(ids, key=lambda x: (-scores[x], x))[:10]
    assert list(i) == best and list(s) == list(scores[best])
    assert len(opened) < 20  # of 64 leaves


def test_products_are_exact():
    a = np.array([[(1 << 30) + 1, 3], [-(1 << 30), 5]])
    assert negatives.dot(a, a).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, t)) for t in a] for r in a]


def brute_codes(rows, width=16, parts=16, entries=64, rounds=2):
    held = [(r[0], r[2], whole(r[1], width)) for r in rows if usable(r[1])]
    order = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, [int(x) for x in r[2]]))[:entries]
    wide = width // parts
    books = [[tuple(r[2][p * wide : (p + 1) * wide]) for r in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = collections.defaultdict(list)
        for _, _, v in held:
            for p in range(parts):
                x = v[p * wide : (p + 1) * wide]
                sums[p, nearest(p, x)[1]].append(x)
        for (p, k), xs in sums.items():
            books[p][k] = tuple(int(c) // len(xs) for c in np.sum(xs, axis=0))
    out, by_label = [], collections.Counter()
    for i, label, v in held:
        found = [nearest(p, v[p * wide : (p + 1) * wide]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, by_label[label], digest) for i, code, e, label in out), key=repr)


@pytest.mark.parametrize("width", [16, 32])
def test_product_codes(spark, width):
    rows = [r for r in vector_rows(300, width) if r[1] != []]
    found = codes.product_codes(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, width)


def test_product_codes_of_few_rows(spark, vectors):
    assert codes.product_codes(vectors.limit(0)).count() == 0
    assert codes.product_codes(vectors.where("embedding IS NULL")).count() == 0
    rows = vector_rows()[:3] + [(4, [], 1, "x", "y", "z", "w")]
    found = codes.product_codes(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows)


def test_orchard_equals_full_search_with_fewer_distances():
    rnd = np.random.default_rng(2)
    entries = rnd.integers(-60, 60, (64, 4))
    entries[9] = entries[3]  # ties
    points = np.concatenate([rnd.integers(-70, 70, (3000, 4)), entries])
    best, gap, computed = codes.orchard(points, entries)
    full = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (gap == full.min(axis=1)).all()
    assert computed < 0.6 * full.size


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["<end>"]


def brute_model(train):
    words, pairs = collections.Counter(), collections.Counter()
    for t in train:
        words.update(t)
        pairs.update(zip(["<begin>"] + t, t))
    total = sum(words.values())
    unit = total + 0.1 * (len(words) + 1)
    q = {k: 1.5 * 2 ** math.floor(math.log2(c)) - 0.5 for k, c in pairs.items() if c >= 2}
    mass = collections.Counter()
    for (a, _), x in q.items():
        mass[a] += x

    def score(t):
        base = sum(math.log10((words[w] + 0.1) / unit) for w in t)
        full = sum(math.log10((min(q.get((u, w), 0), words[w]) + 2 * (words[w] + 0.1) / unit) / (mass[u] + 2)) for u, w in zip(["<begin>"] + t, t))
        return sum(words[w] > 0 for w in t), total, base, full

    return score


@pytest.fixture(scope="module")
def prose(spark, texts):
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(300)]
    chain = {w: rnd.sample(words, 4) for w in words}
    rows = []
    for i in range(400):
        w, out = rnd.choice(words), []
        for _ in range(rnd.randint(1, 60)):
            out.append(w.upper() if rnd.random() < 0.1 else w)
            w = rnd.choice(chain[w]) if rnd.random() < 0.8 else rnd.choice(words)
        rows.append((i, " ".join(out), "x", 1, 2, 3.0))
    rows += [(1000 + i, t, "x", 1, 2, 3.0) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "w1 w2 a missing key", "x", 1, 2, 3.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, tail string, n_tokens int, digest int, base double").repartition(4).cache()


@pytest.mark.parametrize("head_words, shard_bytes, blocks", [(1 << 20, 64 << 20, None), (50, 64 << 20, None), (0, 1 << 16, 3)])
def test_scores(prose, monkeypatch, head_words, shard_bytes, blocks):
    monkeypatch.setattr(language, "BITS", 48)  # hardly any false hits
    if blocks:
        monkeypatch.setattr(language.math, "ceil", lambda x: blocks)
    rows, docs = prose
    train = docs.where(~language.held_out(F.col("doc_id")))
    expected = brute_model([split(r[1]) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10])
    model = language.fit(train, head_words=head_words)
    monkeypatch.undo()
    found = language.score(docs, model, head_words=head_words, shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    near = collections.Counter()
    of = {r[0]: split(r[1]) for r in rows}
    for r in found:
        known, total, base, full = expected(of[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(of[r["doc_id"]]), known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        near[abs(r["score"] - full) < 1e-6 * abs(full)] += 1
    assert near[False] <= 2


def test_pairs_help_on_unseen_texts(prose):
    _, docs = prose
    out = language.score_corpus(docs.where("doc_id < 1000"))
    r = out.where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert r["score"] / r["n"] > r["base"] / r["n"] + 0.3


def test_scores_of_nothing(prose, no_docs):
    _, docs = prose
    assert language.score_corpus(no_docs).count() == 0
    blank = language.score(docs, language.fit(docs.limit(0))).collect()
    assert len(blank) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == r["score"] for r in blank)


def test_filter_reads_no_count_too_low():
    h = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, 5000)
    level = np.random.default_rng(7).integers(1, 9, 5000)
    bits = np.zeros(2 * language.BLOCK * 8, bool)
    for up in range(1, 9):
        for probe in range(language.PROBES):
            on = h[level >= up]
            bits[language.block_of(on, 2) * language.BLOCK * 8 + language.bit_place(on, up, probe)] = True
    packed = np.packbits(bits, bitorder="little")
    assert (language.read_counts(packed, h, 0, 2) >= level).all()
    assert (language.read_counts(packed, h, 0, 2) == level).mean() > 0.99
    assert (language.read_counts(packed, h + 1, 0, 2) > 0).mean() < 0.01


def test_tail_lists_counts():
    out = language.tail_lists(3, np.array([2, 0, 2, 2]), np.array([5, 7, 5, 5]), np.array([0, 0, 0, 1]))
    assert isinstance(out, pa.ListArray)
    assert out.to_pylist() == [[{"h": 7, "level": 0, "tf": 1}], [], [{"h": 5, "level": 0, "tf": 2}, {"h": 5, "level": 1, "tf": 1}]]
