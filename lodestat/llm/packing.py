"""Lexical retrieval packing: documents with words in common share a training sequence.

Documents are tokenized once into a table. Their order is that of their most telling token, then of the next ``ROUTE - 1``, so that
likely neighbours stand together, and ranges of this order are dealt out: a frequent token is parted by its next tokens. A shard holds
BM25 weights of ``SHARD_DOCS`` documents in order at a time, with document frequencies of the whole corpus; neighbours in another shard
are out of reach. A seed document asks it, with all its distinct tokens, for its best unused neighbours, which greedily fill the window;
the last one is cut where the window ends, and its rest is the next seed. Only the last window of a shard isn't full: it is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.llm.common import materialise, text_values, whole_text

WINDOW = 2048
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 22
ROUTE, ASKED = 4, 64
K1, B = 1.2, 0.75
MAX_WORDS = 400_000
SUFFIX = b"\xff"  # stands for the end of a word; never part of UTF-8
# Texts made of these characters are stable under NFC and split alike in Python and in the tokenizer.
LATIN = "\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
ODD = re.compile(rf"[^\x00-\x1b\x20-\x7f{LATIN}]")
# Fixed value: the pre-tokenizer's pattern on lower-cased text, with its letter classes for the characters above.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")


class Encoder(dict):
    """Token ids of texts as little-endian bytes; ids of chunks between white space are kept."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        vocab = spec["model"]["vocab"]
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        # a byte's character in the tokenizer's alphabet: itself where printable, else the next free code point above 255
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in printable}
        letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
        code = {c: b for b, c in letter.items()}
        names = [letter[b] for b in range(256)] + [letter[b] + "</w>" for b in range(256)]
        names += ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]

        def body(name: str) -> bytes:
            return bytes(code[c] for c in name.removesuffix("</w>")) + (SUFFIX if name.endswith("</w>") else b"")

        ranks: dict[bytes, int] = {}
        self.ids: list[bytes] = []
        for name in names:
            ranks.setdefault(body(name) if name != letter[255] else SUFFIX, len(self.ids))
            self.ids.append(np.array(vocab[name], dtype=self.kind).tobytes())
        # every byte must have a rank; one that repeats the end mark is never met in UTF-8
        self.fast = tiktoken.Encoding("chunks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        ids, piece = self.ids, self.fast._encode_single_piece
        # ASCII letters alone, most chunks, are one word
        words = (chunk,) if chunk.isascii() and chunk.isalpha() else SPLIT.findall(chunk)
        made = self[chunk] = b"".join([ids[r] for w in words for r in piece(w.encode() + SUFFIX)])
        return made

    def encode(self, text: str) -> bytes:
        if "<|" in text or ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, tokenizer: str, key: str, text: str, end: int = 1) -> DataFrame:
    """``id, ids, tokens, seen`` per row; the last row of a task has no ids but, in ``tokens`` and ``seen``, document frequencies."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("seen", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, id_type = encoder(tokenizer), pa.int64()
        tail = np.array([end], dtype=known.kind).tobytes()
        counts, n = np.zeros(known.whole.get_vocab_size() + 1, np.int64), 0
        names = ["id", "ids", "tokens", "seen"]

        def batch_of(ids_column: pa.Array, made: list, tokens: list, seen: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids_column, pa.array(made, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.int64()))], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [known.encode(t) + tail for t in text_values(part.column(1))]
                for ids in made:
                    counts[np.frombuffer(ids, known.kind)] += 1  # an index that repeats adds once
                n += len(made)
                yield batch_of(part.column(0), made, [None] * len(made), [None] * len(made))
        used = np.flatnonzero(counts)
        if n:
            yield batch_of(pa.array([None], id_type), [None], [[-1, *used.tolist()]], [[n, *counts[used].tolist()]])

    return docs.select(F.col(key).alias("id"), whole_text(text).alias("body")).mapInArrow(run, schema)


@functools.lru_cache(4)
def id_code(path: str) -> str:
    """Type of stored ids: two bytes where the vocabulary allows."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a document and their BM25 weights."""
    # as np.unique with counts; sixteen-bit ids are sorted by digits
    ordered = np.sort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ordered[1:] != ordered[:-1]]))
    terms, tf = ordered[starts], np.diff(starts, append=len(ids))
    return terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))


class Shard:
    """BM25 weights of some documents, and the windows they fill."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs = docs
        pairs = [weights(d, idf, mean) for d in docs]
        self.starts = np.cumsum([0, *[len(t) for t, _ in pairs]])
        terms = np.concatenate([t for t, _ in pairs])
        held = np.zeros(len(idf), bool)
        held[terms] = True
        self.terms = (np.cumsum(held) - 1)[terms]  # numbers from 0, in the order of the ids
        self.scores = np.concatenate([w for _, w in pairs])
        self.asked = np.zeros(held.sum())
        self.found = np.empty(len(self.terms))
        self.free = np.ones(len(docs), bool)

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents, best BM25 score first; those without a common term follow in order."""
        query = self.terms[self.starts[seed] : self.starts[seed + 1]]
        self.asked[query] = 1.0
        np.take(self.asked, self.terms, out=self.found, mode="clip")
        self.found *= self.scores
        score = np.add.reduceat(self.found, self.starts[:-1])
        self.asked[query] = 0.0
        unused = np.flatnonzero(self.free)
        if len(unused) > ASKED:
            unused = unused[np.argpartition(-score[unused], ASKED)[:ASKED]]
        return unused[np.argsort(-score[unused], kind="stable")].tolist()

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, length)."""
        window: list[tuple[int, int, int]] = []
        space, rest, after = WINDOW, None, 0
        while True:
            if rest is None:
                after += int(self.free[after:].argmax()) if self.free[after:].any() else len(self.free)
                if after >= len(self.free):
                    break
                rest, self.free[after] = (after, 0), False
            doc, start = rest
            take = min(space, len(self.docs[doc]) - start)
            window.append((doc, start, take))
            space -= take
            rest = (doc, start + take) if start + take < len(self.docs[doc]) else None
            while space and rest is None:
                ranked = self.neighbours(doc)
                if not ranked:
                    break
                for other in ranked:
                    if len(self.docs[other]) <= space:
                        window.append((other, 0, len(self.docs[other])))
                        space -= len(self.docs[other])
                        self.free[other] = False
                left = [o for o in ranked if self.free[o]]
                if space and left:
                    window.append((left[0], 0, space))
                    self.free[left[0]] = False
                    rest, space = (left[0], space), 0
            if not space:
                yield window
                window, space = [], WINDOW
        if window:
            yield from powers_of_two(window)


def powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a short window, cut into sequences whose lengths are its binary digits."""
    total = sum(n for _, _, n in window)
    todo = list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        size = 1 << bit
        if not total & size:
            continue
        out = []
        while size:
            doc, start, n = todo.pop()
            take = min(n, size)
            out.append((doc, start, take))
            size -= take
            if take < n:
                todo.append((doc, start + take, n - take))
        yield out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids (no special tokens added) and then ``end``; missing and empty texts are ``end`` alone. Every id lies in
    one piece; sequences hold ``WINDOW`` ids or a power of two. Repeated rows are packed once each; rows with a missing key keep it
    missing. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType
    table = materialise(encode(docs, tokenizer, key, text, end))
    stats = table.where("ids IS NULL").select(F.explode(F.arrays_zip("tokens", "seen")).alias("s"))
    stats = stats.groupBy(F.col("s.tokens").alias("token")).agg(F.sum("s.seen").alias("df")).collect()  # at most one row per token of the vocabulary
    df = {r["token"]: r["df"] for r in stats}
    n_docs = df.pop(-1, 0)
    seen = np.zeros(max(df, default=0) + 2, np.int64)
    for t, c in df.items():
        seen[t] = c
    idf = np.log(1 + (n_docs - seen + 0.5) / (seen + 0.5))
    rows = table.where("ids IS NOT NULL")
    code = id_code(tokenizer)
    width = np.dtype(code).itemsize
    total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    mean = max(1.0, total / width / max(1, n_docs))

    names = [f"route{i}" for i in range(ROUTE)]
    routed = T.StructType([
        T.StructField("id", kind), T.StructField("ids", T.BinaryType()), *[T.StructField(c, T.IntegerType()) for c in names], T.StructField("tie", T.LongType()),
    ])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes, ties = [], []
            for value in batch.column(1):
                body = value.as_py()
                terms, w = weights(np.frombuffer(body, code), idf, mean)
                w = np.where(seen[terms] > 1, w, 0.0)
                best = terms[np.argsort(-w, kind="stable")[:ROUTE]].tolist()
                routes.append(best + [-1] * (ROUTE - len(best)))
                ties.append(zlib.crc32(body))
            tokens = np.array(routes, np.int32).reshape(-1, ROUTE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in tokens.T.copy()], pa.array(ties, pa.int64())], names=routed.names)

    out_schema = T.StructType([
        T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in Shard(ids, idf, mean).windows():
                offset = 0
                for doc, start, n in window:
                    crc = zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes())
                    rows.append((doc, start, n, crc, len(ids[doc]), sequence, offset))
                    offset += n
                sequence += 1
            made = np.array(rows, dtype=np.int64)
            owner = pa.array(keys).take(pa.array(made[:, 0])) if any(k is not None for k in keys) else pa.nulls(len(made))
            return pa.RecordBatch.from_arrays([owner.cast(key_type), *[pa.array(made[:, i]) for i in range(1, 7)]], names=out_schema.names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, body in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                ids.append(np.frombuffer(body.as_py(), code))
                held += len(ids[-1])
                if len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    yield flush()
                    keys, ids, held = [], [], 0
        if ids:
            yield flush()

    # written first, as dealing out ranges reads the order twice; the row number parts rows that are alike in everything
    order = [*names, "tie", "id", "row"]
    shards = materialise(rows.select("id", "ids").mapInArrow(route, routed).withColumn("row", F.monotonically_increasing_id()))
    shards = shards.repartitionByRange(*order).sortWithinPartitions(*order)
    return shards.select("id", "ids").mapInArrow(fill, out_schema)
