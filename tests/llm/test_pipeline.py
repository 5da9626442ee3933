"""The pipeline's stages, each judged on its own input."""

import collections
import hashlib
import math
import zlib

import corpus_pipeline
import numpy as np
from lodestat.llm import packing, quality
from lodestat.llm.common import materialise
from lodestat.llm.queries import tokenizer
from test_text_groups import LOWER, brute_components


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, folder))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        old = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
        if name == "quality_classifier":
            tested = [i for i in old & labels.keys() if zlib.crc32(str(i).encode()) % 3 == 1]
            assert sum((i in ids) == bool(labels[i]) for i in tested) >= 0.85 * len(tested)
        if name == "exact_dedup":
            assert docs.count() == before.selectExpr("lower(text)").distinct().count()
    assert all(n <= packing.WINDOW for (n,) in docs.groupBy("sequence_id").sum("length").select("sum(length)").collect())


def brute_exact(rows):
    last = {}
    for r in rows:
        text = (r["text"] or "").translate(LOWER)
        if text not in last or last[text]["doc_id"] < r["doc_id"]:
            last[text] = r
    return list(last.values())


def brute_near(rows):
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows], 80)
    return [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]


def brute_mix(rows):
    size = collections.Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    root = sum(math.sqrt(n) for n in size.values())
    out = []
    for r in rows:
        n = size[r["source"]]
        rate = math.sqrt(n) / root * sum(size.values()) / n if n else 1.0
        u = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        copies, part = 0, math.exp(-rate)
        below = part
        while below <= u:
            copies += 1
            part *= rate / copies
            below += part
        out += [r] * copies
    return out


def check_pieces(rows, pieces):
    """Every id of every copy of a document in one piece, sequences without gaps, full or powers of two."""
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    copies = collections.Counter(r["doc_id"] for r in rows)
    ids = {r["doc_id"]: np.array([*known.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in rows}
    held = {k: np.zeros(len(v), int) for k, v in ids.items()}
    filled = collections.defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        cut = own[p["start"] : p["start"] + p["length"]]
        assert len(cut) == p["length"] > 0 and p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(cut.tobytes())
        held[p["doc_id"]][p["start"] : p["start"] + p["length"]] += 1
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    assert all((held[k] == copies[k]).all() for k in ids)
    for parts in filled.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total == packing.WINDOW or total & (total - 1) == 0


def test_run_matches_brute_force(spark, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # copies that differ in case, and chains of edits, of good texts
    first = [r for r in docs.orderBy("doc_id").collect() if len(set(r["text"].split())) > 80][:30]
    more = []
    for i, r in enumerate(first):
        for j, text in enumerate((r["text"].upper() if r["text"].isascii() else r["text"], r["text"] + " added", "before " + r["text"])):
            more.append((100_000 + 10 * i + j, text, r["lang"], r["source"], len(text)))
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    monkeypatch.setattr(corpus_pipeline, "materialise", lambda df: stages.append(materialise(df)) or stages[-1])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [s.collect() for s in stages]
    assert len(rows) == 6 and collections.Counter(out) == collections.Counter(rows[-1])
    model = quality.fit_labels(stages[0], labels)
    want = [r for r in rows[0] if quality.score_text(r["text"] or "", model) >= 0.5]
    for name, mine in (("quality", want), ("exact", brute_exact(rows[1])), ("near", brute_near(rows[2])), ("mixing", brute_mix(rows[3]))):
        at = ["quality", "exact", "near", "mixing"].index(name)
        assert collections.Counter(mine) == collections.Counter(rows[at + 1]), name
        assert len(mine) and (collections.Counter(mine) != collections.Counter(rows[at])), name  # a stage that passes on its input shows nothing
    check_pieces(rows[4], rows[5])
