"""Queries over the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.functions.words import ENTITY_PATTERNS, STOPWORDS_ENGLISH
from lodestat.operators import similarity as S
from lodestat.operators import text as L
from lodestat.plans.registry import query


def lit(s):
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(lit(w) for w in STOPWORDS_ENGLISH) + "]"
W = r"[\p{L}\p{N}_]"
PUNCT = r"[^\p{L}\p{N}_\s]"


def sub(x, pattern, to):
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def clean_sql(x, numbers=False):
    x = f"lower({x})"
    for p in (r"http\S+|www\S+", r"\S+@\S+", "<.*?>", rf"@{W}+|#{W}+"):
        x = sub(x, p, "")
    if numbers:
        x = sub(x, r"\p{Nd}+", "")
    return f"trim({sub(sub(x, PUNCT, ' '), chr(92) + 's+', ' ')})"


def words_sql(x):
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda z: z <> '')"


def nostop(x):
    return f"list_filter({x}, lambda z: NOT list_contains({STOP}, lower(z)))"


CLEAN = clean_sql("text")
TOKENS = nostop(words_sql(CLEAN))


@query("clean_text", f"SELECT doc_id, {CLEAN} AS clean, {clean_sql('text', True)} AS clean_no_numbers FROM documents")
def _(t):
    return t.documents.select("doc_id", L.clean_text(F.col("text")).alias("clean"), L.clean_text(F.col("text"), remove_numbers=True).alias("clean_no_numbers"))


@query("clean_html", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", L.clean_text(F.col("html")).alias("clean"))


@query("normalize_letters", rf"SELECT doc_id, trim({sub(sub('lower(text)', '[^a-zA-Z가-힣' + chr(92) + 's]', ''), chr(92) + 's+', ' ')}) AS letters FROM documents")
def _(t):
    return t.documents.select("doc_id", L.normalize_letters(F.col("text")).alias("letters"))


SENT = rf"list_filter(list_transform(string_split(text, '.'), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '')"


@query(
    "tokenize",
    f"SELECT doc_id, array_to_string({words_sql('text')}, '|') AS words, len({words_sql('text')}) AS n_words, len({SENT}) AS n_sentences, array_to_string({SENT}, '|') AS sentences FROM documents",
)
def _(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.array_join(L.tokenize(x), "|").alias("words"), F.size(L.tokenize(x)).cast("long").alias("n_words"),
        F.size(L.tokenize(x, "sentence")).cast("long").alias("n_sentences"), F.array_join(L.tokenize(x, "sentence"), "|").alias("sentences"),
    )


@query("remove_stopwords", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS kept FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(L.remove_stopwords(L.words(L.clean_text(F.col("text")))), " ").alias("kept"))


@query("stem")
def _(t):
    terms = t.documents.select("doc_id", F.explode(L.words(L.clean_text(F.col("text")))).alias("term"))
    return L.stem_terms(terms.groupBy("term").agg(F.count(F.lit(1)).alias("cnt")))


@query(
    "ngrams",
    f"""WITH w AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations)
        SELECT conv_id, turn, array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') AS bigrams FROM w""",
)
def _(t):
    return t.conversations.select("conv_id", "turn", F.array_join(L.ngrams(L.words(F.col("text"))), "|").alias("bigrams"))


def count_re(p):
    return f"len(regexp_extract_all(text, {lit(p)}))"


@query(
    "text_features",
    f"""WITH w AS (SELECT doc_id, text, {words_sql(CLEAN)} AS w FROM documents)
        SELECT doc_id, length(text) AS character_count, len(w) AS word_count, len({SENT}) AS sentence_count,
          CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda z: length(z))) / len(w) END AS avg_word_length,
          len(list_distinct(w)) AS unique_words, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS lexical_diversity,
          {count_re(r'\p{Lu}')} AS uppercase_count, {count_re(r'\p{Nd}')} AS digit_count, {count_re('[.,!?;:]')} AS punctuation_count, {count_re(chr(92) + 's')} AS whitespace_count FROM w""",
    approx=("avg_word_length", "lexical_diversity"),
)
def _(t):
    out = L.text_features(t.documents.select("doc_id", "text"), "text").drop("text")
    return out.select(*[F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in out.dtypes])


@query(
    "common_words",
    f"""WITH w AS (SELECT doc_id, unnest({TOKENS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS cnt FROM w GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, word) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
)
def _(t):
    return L.common_words(t.documents, ["doc_id"], "text")


@query(
    "preprocess_batch",
    f"SELECT count(*) AS texts, CAST(sum(len({TOKENS})) AS BIGINT) AS total_tokens, avg(len({TOKENS})) AS mean_tokens FROM documents",
    approx=("mean_tokens",),
)
def _(t):
    return L.preprocess_batch(t.documents, "text")


@query(
    "detect_script",
    """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) AS k, len(regexp_extract_all(text, '[a-zA-Z가-힣]')) AS n FROM documents)
       SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE k / n END AS korean_ratio, CASE WHEN n = 0 THEN FALSE ELSE k / n > 0.3 END AS is_korean FROM c""",
    approx=("korean_ratio",),
)
def _(t):
    return L.detect_script(t.documents.select("doc_id", "text"), "text").drop("text")


@query("detect_language")
def _(t):
    return L.detect_language(t.documents, ["doc_id"], "text")


@query(
    "detect_language_check",
    """WITH p AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{k}', {lit(w)})" for k, ws in L.LANGUAGE_PROFILES.items() for w in ws)
    + r""") v(language, word)),
       w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'), '\s+'), lambda z: z <> '') AS w FROM documents),
       h AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w), s AS (SELECT doc_id, language, count(*) / max(n) AS share FROM h JOIN p USING (word) GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, language) AS k FROM s)
       SELECT d.doc_id, coalesce(language, 'unknown') AS language FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND k = 1""",
)
def _(t):
    return L.detect_language(t.documents, ["doc_id"], "text").select("doc_id", "language")


def terms_sql(x, two=True):
    one = nostop(f"regexp_extract_all(lower({x}), {lit(W + W + '+')})")
    return one, "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))" if two else "w"


ONE, BOTH = terms_sql("text")


def tf_sql(table, key, extra=""):
    return f"(SELECT {extra}{key}, term, count(*) AS tf FROM (SELECT {extra}{key}, unnest({BOTH}) AS term FROM (SELECT {extra}{key}, {ONE} AS w FROM {table} t0) t1) t2 GROUP BY ALL)"


@query(
    "keywords",
    f"""WITH c AS (SELECT * FROM {tf_sql('documents', 'doc_id')} x), n AS (SELECT count(*) AS n FROM documents),
        v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 ORDER BY total DESC, term LIMIT 20),
        w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, df, n FROM c JOIN v USING (term), n),
        m AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w)
        SELECT term, sum(u) / max(n) AS score, max(df) AS df FROM m GROUP BY 1""",
    approx=("score",),
)
def _(t):
    return L.keywords(t.documents, ["doc_id"], "text")


@query(
    "keywords_count",
    f"SELECT term, CAST(sum(tf) AS DOUBLE) AS score, count(*) AS df FROM {tf_sql('documents', 'doc_id')} x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def _(t):
    return L.keywords(t.documents, ["doc_id"], "text", method="count")


@query(
    "keywords_by_class",
    f"""WITH k AS (SELECT DISTINCT lang FROM documents),
        c AS (SELECT * FROM {tf_sql('documents', 'doc_id', 'lang, ')} x WHERE lang IN (SELECT lang FROM k)), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
        s AS (SELECT lang, term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1, 2),
        v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY total DESC, term) AS k FROM s QUALIFY k <= 10),
        w AS (SELECT lang, doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w, df, n FROM c JOIN v USING (lang, term) JOIN n USING (lang)),
        m AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id)) AS u FROM w)
        SELECT lang, term, sum(u) / max(n) AS score, max(df) AS df FROM m GROUP BY 1, 2""",
    approx=("score",),
)
def _(t):
    return L.keywords_by_class(t.documents, ["doc_id"], "text", "lang")


@query(
    "text_dataset_stats",
    f"""SELECT count(*) AS total_texts, avg(length(text)) AS avg_text_length, avg(len({words_sql('text')})) AS avg_word_count, max(length(text)) AS max_text_length,
        min(length(text)) AS min_text_length, stddev_pop(length(text)) AS std_text_length FROM documents""",
    approx=("avg_text_length", "avg_word_count", "std_text_length"),
)
def _(t):
    return L.text_dataset_stats(t.documents, "text")


@query("label_shares", "SELECT lang AS label, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1", approx=("share",))
def _(t):
    return L.label_shares(t.documents, "lang")


# scores for frequent words of the test texts, so that the lexicon finds something
SCORES = {"the": 0.4, "of": -0.3, "and": 0.2, "heed": 1.5, "ing": -1.1, "tion": 0.9, "la": 0.3, "der": -0.2, "que": 0.5, "with": -0.4, "les": -0.6}
LEX = "(SELECT * FROM (VALUES " + ", ".join(f"('{w}', {s})" for w, s in SCORES.items()) + ") v(word, s))"


def senti_sql(src, keys, text, limit=0.05):
    k = ", ".join(keys)
    on = " AND ".join(f"d.{c} = h.{c}" for c in keys)
    return f"""(SELECT {", ".join("d." + c for c in keys)}, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS score, coalesce(hits, 0) AS hits FROM {src} d LEFT JOIN
      (SELECT {k}, sum(CAST(s AS DOUBLE)) AS s, count(*) AS hits FROM (SELECT {k}, unnest({words_sql(sub(f'lower({text})', PUNCT, ' '))}) AS word FROM {src} z) JOIN {LEX} l USING (word) GROUP BY ALL) h ON {on})"""


BAND = "CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END"
SENTI = f"(SELECT *, {BAND} AS sentiment FROM {senti_sql('documents', ['doc_id'], 'text')} y)"


@query("sentiment", f"SELECT * FROM {SENTI} x", approx=("score",))
def _(t):
    return L.sentiment(t.documents, ["doc_id"], "text", L.lexicon_frame(t.spark, SCORES))


@query("sentiment_default_lexicon")
def _(t):
    return L.sentiment(t.conversations, ["conv_id", "turn"], "text")


@query(
    "sentiment_distribution",
    f"""SELECT count(*) AS n, {", ".join(f"count(*) FILTER (sentiment = '{k}') AS {k}, 100.0 * count(*) FILTER (sentiment = '{k}') / count(*) AS {k}_pct" for k in ("positive", "negative", "neutral"))},
        avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, median(score) AS median,
        CASE WHEN avg(score) >= 0.05 THEN 'positive' WHEN avg(score) <= -0.05 THEN 'negative' ELSE 'neutral' END AS overall FROM {SENTI} x""",
    approx=("positive_pct", "negative_pct", "neutral_pct", "mean", "std", "min", "max", "median"),
)
def _(t):
    return L.sentiment_distribution(L.sentiment(t.documents, ["doc_id"], "text", L.lexicon_frame(t.spark, SCORES)))


@query(
    "sentiment_aspects",
    f"""WITH s AS (SELECT doc_id, unnest(range(1, len(string_split(text, '.')) + 1)) AS i, string_split(text, '.') AS p FROM documents),
        t AS (SELECT doc_id, i, p[i] AS sentence FROM s), a AS (SELECT unnest(['heed', 'eau', 'tion']) AS aspect),
        m AS (SELECT doc_id, i, sentence, aspect FROM t JOIN a ON contains(lower(sentence), aspect)),
        g AS (SELECT doc_id, i, score FROM {senti_sql('t', ['doc_id', 'i'], 'sentence')} y),
        r AS (SELECT doc_id, aspect, avg(score) AS score, count(*) AS mentions, arg_min(sentence, i) AS example FROM m JOIN g USING (doc_id, i) GROUP BY 1, 2)
        SELECT *, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment FROM r""",
    approx=("score",),
)
def _(t):
    return L.sentiment_aspects(t.documents, ["doc_id"], "text", ["heed", "eau", "tion"], L.lexicon_frame(t.spark, SCORES))


VEC = f"""c AS (SELECT * FROM {tf_sql('documents', 'doc_id')} x), n AS (SELECT count(*) AS n FROM documents),
  v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT n FROM n)),
  w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), n),
  vec AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)"""


@query("tfidf_vectors", f"WITH {VEC} SELECT * FROM vec", approx=("w",))
def _(t):
    return S.tfidf_vectors(t.documents, "doc_id", "text")


@query(
    "similarity_pair",
    f"WITH {VEC} SELECT coalesce(sum(a.w * b.w), 0) AS similarity FROM vec a JOIN vec b USING (term) WHERE a.doc_id = 2 AND b.doc_id = 1",
    approx=("similarity",),
)
def _(t):
    return S.similarity_pair(S.tfidf_vectors(t.documents, "doc_id", "text", only=[1, 2]), "doc_id", 1, 2)


# "similarity_matrix": every pair at or above a positive threshold
@query(
    "similarity_matrix",
    f"""WITH {VEC.replace('documents', 'benchmark').replace('doc_id', 'item_id')}
        SELECT a.item_id AS a, b.item_id AS b, sum(a.w * b.w) AS similarity FROM vec a JOIN vec b USING (term) WHERE a.item_id < b.item_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.05""",
    approx=("similarity",),
)
def _(t):
    return S.similar_pairs(S.tfidf_vectors(t.benchmark, "item_id", "text"), "item_id", 0.05)


@query(
    "similar_top_k",
    f"""WITH {VEC}, q AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({BOTH}) AS term FROM (SELECT item_id, {ONE} AS w FROM benchmark) t1) t2 GROUP BY ALL),
        qw AS (SELECT item_id, term, (1 + ln(q.tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM q JOIN v USING (term), n),
        qv AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM qw),
        s AS (SELECT item_id AS query, doc_id, sum(qv.w * vec.w) AS similarity FROM qv JOIN vec USING (term) GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(similarity, 10) DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
    approx=("similarity",),
)
def _(t):
    vectors = S.tfidf_vectors(t.documents, "doc_id", "text")
    queries = S.query_vectors(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")
    return S.similar_top_k(vectors, "doc_id", queries, "item_id", 5)


@query(
    "near_duplicates",
    f"""WITH {VEC}, f AS (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1),
        d AS (SELECT doc_id, first FROM documents JOIN f ON md5(text) = h),
        u AS (SELECT vec.* FROM vec JOIN d ON d.doc_id = vec.doc_id AND d.doc_id = first)
        SELECT first AS a, doc_id AS b, 1.0 AS similarity FROM d WHERE doc_id <> first
        UNION ALL SELECT a.doc_id, b.doc_id, sum(a.w * b.w) FROM u a JOIN u b USING (term) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.95""",
    approx=("similarity",),
)
def _(t):
    return S.near_duplicates(t.documents, "doc_id", "text")


@query("cluster_documents")
def _(t):
    return S.cluster_documents(t.documents, "doc_id", "text", 5)


@query("topics_lda")
def _(t):
    return S.topics_lda(t.documents, "doc_id", "text", 4)[0]


@query("topics_nmf")
def _(t):
    return S.topics_nmf(t.documents, "doc_id", "text", 4)[0]


@query("document_topics")
def _(t):
    return S.document_topics(S.topics_lda(t.documents, "doc_id", "text", 4)[1], "doc_id")


TOPICS = {0: ["the", "and", "that", "with"], 1: ["der", "und", "von", "die"], 2: ["les", "des", "que", "heed"]}


@query(
    "topic_coherence",
    f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{a}', '{b}')" for k, ws in TOPICS.items() for i, a in enumerate(sorted(ws)) for b in sorted(ws)[i + 1:])}) v(topic, a, b)),
        d AS (SELECT doc_id, {words_sql(sub('lower(text)', PUNCT, ' '))} AS w FROM documents), n AS (SELECT count(*) AS n FROM documents),
        c AS (SELECT topic, a, b, count(*) FILTER (list_contains(w, a)) AS ca, count(*) FILTER (list_contains(w, b)) AS cb, count(*) FILTER (list_contains(w, a) AND list_contains(w, b)) AS cab FROM p, d GROUP BY 1, 2, 3),
        s AS (SELECT topic, CASE WHEN cab = 0 THEN -1.0 WHEN cab = n THEN 1.0 ELSE ln(cab / n * n * n / (CAST(ca AS DOUBLE) * cb)) / -ln(cab / n) END AS v FROM c, n)
        SELECT topic, avg(v) AS coherence, count(*) AS pairs FROM s GROUP BY 1""",
    approx=("coherence",),
)
def _(t):
    rows = [(k, w) for k, ws in TOPICS.items() for w in ws]
    return S.topic_coherence(t.documents, "text", t.spark.createDataFrame(rows, "topic int, word string"))


def entity_sql(label, pattern):
    p = lit(pattern)
    return f"""SELECT doc_id, '{label}' AS label, h[i] AS entity, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: length(z))), 0) AS INTEGER) AS start
      FROM (SELECT doc_id, g, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS g, regexp_extract_all(text, {p}) AS h FROM documents) a) b"""


ENT = "(" + " UNION ALL ".join(entity_sql(k, p) for k, p in ENTITY_PATTERNS.items()) + ")"


@query("entities", f"SELECT *, CAST(start + length(entity) AS INTEGER) AS stop FROM {ENT} x")
def _(t):
    return L.entities(t.documents, ["doc_id"], "text")


DICT = [("heed", "WORD"), ("the", "ARTICLE"), ("der", "ARTICLE"), ("les", "ARTICLE")]


@query(
    "entities_dictionary",
    f"""WITH w AS (SELECT doc_id, {words_sql(sub('lower(text)', PUNCT, ' '))} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        d AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in DICT)}) v(phrase, label))
        SELECT doc_id, label, phrase AS entity, CAST(i - 1 AS INTEGER) AS token FROM p JOIN d ON w[i] = phrase""",
)
def _(t):
    return L.entities_dictionary(t.documents, ["doc_id"], "text", t.spark.createDataFrame(DICT, "phrase string, label string"))


PHRASES = [("the", "A"), ("the the", "B"), ("is is is", "C"), ("is is", "B"), ("nd nd nd nd", "D"), ("de de", "B"), ("the and", "E"), ("and", "A"), ("The, and!", "F"), ("...", "G")]
PHRASE_ROWS = [("the", 1, "A"), ("the the", 2, "B"), ("is is is", 3, "C"), ("is is", 2, "B"), ("nd nd nd nd", 4, "D"), ("de de", 2, "B"), ("the and", 2, "E"), ("and", 1, "A")]


@query(
    "entities_phrases",
    f"""WITH RECURSIVE d AS (SELECT * FROM (VALUES {", ".join(map(str, PHRASE_ROWS))}) v(entity, n, label)),
        w AS (SELECT doc_id, {words_sql(sub('lower(text)', PUNCT, ' '))} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        c AS (SELECT doc_id, i - 1 AS token, n, label, entity FROM p JOIN d ON array_to_string(w[i : i + n - 1], ' ') = entity),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, token ORDER BY n DESC) = 1),
        s AS (SELECT a.*, (SELECT min(z.token) FROM b z WHERE z.doc_id = a.doc_id AND z.token >= a.token + a.n) AS after FROM b a),
        r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY token) = 1
          UNION ALL SELECT s.* FROM r JOIN s ON s.doc_id = r.doc_id AND s.token = r.after)
        SELECT doc_id, label, entity, CAST(token AS INTEGER) AS token, n AS n_tokens FROM r""",
)
def _(t):
    return L.entities_phrases(t.documents, ["doc_id"], "text", t.spark.createDataFrame(PHRASES, "phrase string, label string"))


@query("filter_entities", f"SELECT doc_id, label, entity FROM {ENT} x WHERE label IN ('EMAIL', 'URL')")
def _(t):
    return L.filter_entities(L.entities(t.documents, ["doc_id"], "text"), ["EMAIL", "URL"]).select("doc_id", "label", "entity")


@query("entity_frequencies", f"SELECT label, count(*) AS cnt FROM {ENT} x GROUP BY 1")
def _(t):
    return L.entity_frequencies(L.entities(t.documents, ["doc_id"], "text"))


@query(
    "entity_summary",
    f"""WITH c AS (SELECT label, entity, count(*) AS cnt FROM {ENT} x GROUP BY 1, 2),
        s AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY cnt DESC, entity) AS INTEGER) AS rank, CAST(sum(cnt) OVER (PARTITION BY label) AS BIGINT) AS total,
          count(*) OVER (PARTITION BY label) AS n_distinct FROM c) SELECT * FROM s WHERE rank <= 10""",
)
def _(t):
    return L.entity_summary(L.entities(t.documents, ["doc_id"], "text"))


@query("text_classifier")
def _(t):
    data = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "quality")
    return S.text_classifier(data, ["doc_id"], "text", "quality", ["logistic", "naive_bayes_multinomial", "linear_svm", "random_forest"])
