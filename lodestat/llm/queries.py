"""Named queries of the text operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.codes import product_codes
from lodestat.llm.common import read_table
from lodestat.llm.exact import dedup_exact
from lodestat.llm.imatch import compare_with_edits
from lodestat.llm.language import score_corpus
from lodestat.llm.mixing import poisson_mix
from lodestat.llm.neardup import near_duplicates
from lodestat.llm.negatives import hard_negatives
from lodestat.llm.packing import pack
from lodestat.llm.pii import find_personal
from lodestat.llm import quality
from lodestat.llm.secrets import find_secrets
from lodestat.llm.substrings import remove_repeats
from lodestat.llm.tokens import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(read_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op2_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(read_table(spark, folder, "documents"))


@query("op3_compression_quality")
def compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = quality.fit_labels(docs, read_table(spark, folder, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_setsketch_dedup")
def setsketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), percent=85)


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op5_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy FROM d),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
    SELECT doc_id, text_sha256, keep_id, group_size, doc_id = keep_id AND copy = 1 AS kept FROM r JOIN g USING (text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_exact(read_table(spark, folder, "documents"), f"digest_index_{uuid.uuid4().hex}")


@query("op6_imatch")
def imatch(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_edits(read_table(spark, folder, "documents"))


@query("op7_prefix_doubling")
def prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read_table(spark, folder, "documents")).drop("kept")


MIX_SQL = """
    WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM documents GROUP BY 1),
    w AS (SELECT source, n_chars, sqrt(n_chars) AS raw FROM s),
    t AS (SELECT source, CASE WHEN n_chars > 0 THEN raw / (SELECT sum(raw) FROM w) * (SELECT sum(n_chars)::DOUBLE FROM w) / n_chars ELSE 1 END AS rate FROM w),
    k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM t),
    c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS bound FROM k),
    d AS (SELECT doc_id, source, ('0x' || md5('mix:' || doc_id)[:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
    n AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND bound <= d.u) AS n_copies FROM d),
    e AS (SELECT doc_id, source, n_copies, unnest(range(1, n_copies + 1)) AS copy_no FROM n)
    SELECT doc_id, source, n_copies, copy_no, ('0x' || md5('mix-order:' || doc_id || ':' || copy_no)[:13])::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key FROM e
"""


@query("op8_poisson_mix", MIX_SQL)
def mix(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix(read_table(spark, folder, "documents")).select("doc_id", "source", "n_copies", "copy_no", "shuffle_key")


@query("op9_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(read_table(spark, folder, "documents"))


@query("op10_retrieval_packing")
def retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


NEGATIVES_SQL = """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS place
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""


@query("op11_bloom_scores")
def bloom_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_corpus(read_table(spark, folder, "documents"))


@query("op12_str_negatives", NEGATIVES_SQL)
def str_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


# the same rounds by comparing every part with every entry; parts of four components, as the vectors have 64
CODES_ROUND = """
    n{1} AS (SELECT p.vec_id, p.part, arg_min(e.entry, (list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e.entry)) AS entry,
        min(list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM p JOIN b{0} e USING (part) GROUP BY ALL),
    m{1} AS (SELECT part, entry, [{2}] AS v FROM n{1} JOIN p USING (vec_id, part) GROUP BY ALL),
    b{1} AS (SELECT part, entry, coalesce(m{1}.v, b{0}.v) AS v FROM b{0} LEFT JOIN m{1} USING (part, entry))
"""
MEANS = ", ".join(f"CAST((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, 5))
CODES_SQL = f"""
    WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT vec_id, part, w[4 * part + 1 : 4 * part + 4] AS v FROM r, (SELECT unnest(range(16)) AS part)),
    b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 64),
    {CODES_ROUND.format(0, 1, MEANS)}, {CODES_ROUND.format(1, 2, MEANS)}, {CODES_ROUND.format(2, 3, MEANS)},
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
    c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n3 GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN r USING (vec_id), h
"""


@query("op13_orchard_codes", CODES_SQL)
def orchard_codes(spark: SparkSession, folder: str) -> DataFrame:
    return product_codes(read_table(spark, folder, "embeddings"))
