"""Duplicates, fingerprints, repeats, mixing, packing and the classifier on edge cases, against brute force."""

import collections
import hashlib
import uuid
import zlib

import numpy as np
import pytest

from lodestat.llm import exact, imatch, mixing, neardup, packing, quality, substrings
from lodestat.llm.queries import tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table_name():
    return f"index_{uuid.uuid4().hex}"


def test_exact_dedup(edge_docs, no_docs):
    docs = edge_docs.collect()
    groups = collections.defaultdict(list)
    for r in docs:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    found = exact.dedup_exact(edge_docs, table_name()).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in found) == len(groups)
    assert exact.dedup_exact(no_docs, table_name()).count() == 0


def test_exact_index_remembers(edge_docs):
    name = table_name()
    first = exact.dedup_exact(edge_docs, name)
    n = first.where("kept").count()
    again = exact.dedup_exact(edge_docs.selectExpr("doc_id + 1000 AS doc_id", "text"), name)
    assert again.where("kept").count() == 0 and again.where("keep_id >= 1000").count() == 0
    assert edge_docs.sparkSession.table(name).count() == n


def test_drop_copies_keeps_columns(edge_docs):
    kept = exact.drop_copies(edge_docs, table_name())
    assert kept.columns == edge_docs.columns
    texts = [(r["text"] or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r["text"] or "").translate(LOWER) for r in edge_docs.collect()})


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = [(k, shingles_of(t)) for k, t in rows]
    parent = {k: k for k, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets}


@pytest.mark.parametrize("percent", [80, 95])
def test_near_duplicates(edge_docs, no_docs, percent):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = brute_components([(k, t) for k, t in dict(r for r in rows if r[0] is not None).items()], percent)
    found = neardup.near_duplicates(edge_docs, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert neardup.near_duplicates(no_docs, percent).count() == 0


def test_near_duplicates_of_a_star_need_its_middle(spark):
    """Edits of one original, too far from each other to be linked but through it, and a chain beside it; no link may be lost."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        edit = list(base)
        if i != 17:
            for j in range(7):
                edit[(i * 16 + j * 2 + 3) % 400] = f"e{i}x{j}"
        rows.append((i, " ".join(edit)))
    rows += [(100 + i, " ".join(base[: 200 + 12 * i])) for i in range(12)]
    want = brute_components(rows, 90)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: v[1] for k, v in want.items()}


def test_near_duplicates_apart_from_their_pivot(spark, monkeypatch):
    """Families of edits that aren't linked to the original but among each other; bounds by pivot leave few of the other pairs."""
    import random

    rnd = random.Random(12)
    base = [f"w{i}" for i in range(160)]
    rows = [(0, " ".join(base))]
    for family in range(6):
        edited = list(base)
        for at in rnd.sample(range(160), 5):  # too much for a link to the original
            edited[at] = f"f{family}x{at}"
        for member in range(5):
            own = list(edited)
            own[rnd.randrange(160)] = f"m{family}x{member}"
            rows.append((len(rows), " ".join(own)))
    for i in range(60):  # alone
        own = list(base)
        for at in rnd.sample(range(160), 5):
            own[at] = f"a{i}x{at}"
        rows.append((len(rows), " ".join(own)))
    want = brute_components(rows, 85)
    made = []
    confirm = neardup.confirm
    monkeypatch.setattr(neardup, "confirm", lambda pairs, *a: (made.append(pairs.count()), confirm(pairs, *a))[1])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {k: v[1] for k, v in want.items()}
    assert len({v[1] for v in want.values()}) > 50 and len(made) == 2
    assert made[1] < 0.15 * len(rows) * (len(rows) - 1) / 2


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:])
    merged = np.maximum(neardup.registers(a), neardup.registers(b))
    assert (merged == neardup.registers(np.union1d(a, b))).all()
    same = (neardup.registers(a) == neardup.registers(b)).mean()
    assert abs(same - 2500 / 4000) < 0.2
    assert neardup.likely(neardup.registers(a), neardup.registers(a), len(a), len(a), 0.8)
    assert not neardup.likely(neardup.registers(pool[:1000]), neardup.registers(pool[1000:2000]), 1000, 1000, 0.8)


def test_keep_one(edge_docs):
    kept = neardup.keep_one(edge_docs, 80)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    want = brute_components([(k, t) for k, t in {r["doc_id"]: r["text"] for r in edge_docs.collect() if r["doc_id"] is not None}.items()], 80)
    assert sorted(ids) == sorted({v[1] for v in want.values()}) and len(rows) == len(ids) + 1


def test_fingerprints(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = imatch.compare_with_edits(edge_docs).collect()
    assert len(found) == len(rows)
    prints = collections.defaultdict(set)
    for k, (key, text) in enumerate(rows):
        nxt, q = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = hashlib.sha256((text[: len(text) - q] + nxt[:q]).encode()).hexdigest()
        mine = [r for r in found if r["doc_id"] == key]
        assert any(r["edited_sha256"] == edited and r["n_chars"] == len(text) for r in mine)
        prints[text] |= {r["fingerprint"] for r in mine}
    assert all(len(v) == 1 for v in prints.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert all(r["near_edited"] == 1 for r in found if r["fingerprint"] == r["edited_fingerprint"])
    assert imatch.compare_with_edits(no_docs).count() == 0


def brute_repeats(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = sorted(zip([r[0] or -1 for r in rows], brute_repeats([r[1] for r in rows], substrings.LENGTH)))
    found = substrings.remove_repeats(edge_docs).collect()
    assert sorted(((r["doc_id"] or -1), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in found) == want
    assert substrings.remove_repeats(no_docs).count() == 0


def test_repeats_in_chunks_of_long_texts(monkeypatch):
    rnd = np.random.default_rng(2)
    body = rnd.integers(97, 100, 9000).astype(np.uint8)
    whole = [np.concatenate(x) for x in zip(*substrings.text_intervals(body, np.array([0, 9000])))]
    monkeypatch.setattr(substrings, "CHUNK", 1500)
    parts = [np.concatenate(x) for x in zip(*substrings.text_intervals(body, np.array([0, 9000])))]
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_poisson_mix(spark, no_docs):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 < 2 THEN 'big' WHEN id % 30 = 2 THEN NULL ELSE 'small' END AS source", "repeat('x', 10) AS text", "1 AS rate")
    out = mixing.poisson_mix(docs, {"big": 1.0, "small": 3.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] / 1500 - 1) < 0.1 and abs(n["small"] / 4500 - 1) < 0.1 and None not in n
    again = mixing.poisson_mix(docs.repartition(7), {"big": 1.0, "small": 3.0})
    assert sorted(map(tuple, out.select("doc_id", "copy_no").collect())) == sorted(map(tuple, again.select("doc_id", "copy_no").collect()))
    assert mixing.poisson_mix(no_docs).count() == 0
    assert mixing.poisson_mix(docs.limit(0)).count() == 0


def test_poisson_bounds_of_large_rates(spark):
    from pyspark.sql import functions as F

    for rate in (0.01, 1.0, 900.0):
        b = spark.range(1).select(mixing.poisson_bounds(F.lit(rate)).alias("b")).first()["b"]
        assert abs(b[-1] - 1) < 1e-9 and abs(sum(1 - x for x in b) - rate) < 1e-6 * max(rate, 1)


def test_packing(edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    found = packing.pack(edge_docs, path).collect()
    ids = collections.Counter()
    for r in edge_docs.collect():
        ids[r["doc_id"], tuple(lib.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)] += 1
    pieces = collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    for (key, body), n in ids.items():
        mine = pieces[key]
        assert sum(r["length"] for r in mine) == n * len(body)
        for r in mine:
            part = np.array(body[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(body)
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.WINDOW and at & (at - 1) == 0
    assert packing.pack(no_docs, path).count() == 0


def test_packing_takes_neighbours():
    docs = [np.array(x * 40, np.uint16) for x in ([5, 6, 7, 8], [15, 16, 17, 18], [5, 6, 7, 9], [15, 16, 17, 19])]
    shard = packing.Shard(docs, np.ones(30), 160.0)
    shard.free[0] = False
    assert shard.neighbours(0)[0] == 2


def test_packing_asks_with_all_tokens():
    """The seed shares only its lightest tokens with the third document and nothing with the second."""
    docs = [np.arange(10, 50, dtype=np.uint16), np.arange(60, 100, dtype=np.uint16), np.arange(40, 80, dtype=np.uint16)]
    shard = packing.Shard(docs, np.linspace(9, 1, 100), 40.0)
    shard.free[0] = False
    assert shard.neighbours(0)[0] == 2


def test_packing_keeps_neighbours_together(spark):
    """Groups of eight documents about the same rare words, one of which is in all documents of four groups; each group fills a window at most."""
    import random

    rnd = random.Random(9)
    rows = []
    for group in range(48):
        own = [f"{a}{group % 12}{b}{group // 12}" for a, b in zip("qwzxjk", "vyxkqj")]
        for i in range(8):
            rows.append((i * 1000 + group, " ".join(rnd.choice([f"x{group // 4}y", *own, "the", "of", "and"]) for _ in range(50))))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), tokenizer("word_bpe_49k.json")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    met = collections.defaultdict(set)
    for r in found:
        met[r["sequence_id"]].add(r["doc_id"])
    beside = sum(any(len({d for d in docs if d % 1000 == k % 1000}) > 1 for docs in met.values() if k in docs) for k, _ in rows)
    assert beside >= 0.9 * len(rows)


def test_classifier(spark, no_docs):
    import random

    rnd = random.Random(8)
    syllables = ["tion", "en", "le", "ou", "ré", "ba", "st"]

    def prose():
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(150))

    good = [prose() for _ in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t.upper().replace(" ", "!! "), 0) for i, t in enumerate(good)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_labels(docs, labels)
    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    out = [(found[i]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in out) > 0.95 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000), (None, "a")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())
    assert quality.keep_good(docs, model).count() == sum(r["predicted"] for r in found.values())
    empty = quality.fit_labels(no_docs, labels.limit(0))
    assert quality.score(odd, empty).count() == 4


def test_packing_weights_and_numbers_equal_unique():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 40_000, n).astype(np.uint16) for n in (1, 2, 50, 900)] + [np.full(9, 7, np.uint16)]
    idf = rng.random(40_000)
    for d in docs:
        terms, w = packing.weights(d, idf, 200.0)
        want, tf = np.unique(d, return_counts=True)
        part = idf[want] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / 200.0))
        assert terms.dtype == d.dtype and terms.tolist() == want.tolist() and w.tolist() == part.tolist()
    shard = packing.Shard(docs, idf, 200.0)
    assert shard.terms.tolist() == np.unique(np.concatenate([np.unique(d) for d in docs]), return_inverse=True)[1].tolist()


def test_packing_encodes_a_word_of_letters_without_the_pattern(monkeypatch):
    known = packing.Encoder(str(tokenizer("word_bpe_49k.json")))
    texts = ["Words of LETTERS only", "it's 12 new-words, ça va", "", "a \x1c b\tc\nd"]
    assert [np.frombuffer(known.encode(t), known.kind).tolist() for t in texts] == [known.whole.encode(t, add_special_tokens=False).ids for t in texts]
    known.clear()
    monkeypatch.setattr(packing, "SPLIT", None)
    assert len(np.frombuffer(known.encode("plain words alone"), known.kind)) > 2
