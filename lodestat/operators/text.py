"""Text cleaning, tokens, keywords, sentiment and entities."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.functions import columns as C
from lodestat.functions import ordering as O
from lodestat.functions.words import ENTITY_PATTERNS, LANGUAGE_PROFILES, SENTIMENT, STOPWORDS_ENGLISH
from lodestat.operators.describe import top_values
from lodestat.session import stored

WORD = r"[\p{L}\p{N}_]"

# fixed values: cleaning patterns in the order they apply
URLS = r"http\S+|www\S+"
EMAILS = r"\S+@\S+"
TAGS = r"<.*?>"
HANDLES = rf"@{WORD}+|#{WORD}+"
DIGITS = r"\p{Nd}+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def clean_text(text: Column, lowercase: bool = True, remove_numbers: bool = False, remove_punctuation: bool = True) -> Column:
    out = F.lower(text) if lowercase else text
    for pattern in (URLS, EMAILS, TAGS, HANDLES):
        out = F.regexp_replace(out, pattern, "")
    if remove_numbers:
        out = F.regexp_replace(out, DIGITS, "")
    if remove_punctuation:
        out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.coalesce(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def normalize_letters(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), r"[^a-zA-Z가-힣\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def tokenize(text: Column, method: str = "word") -> Column:
    return words(text) if method == "word" else sentences(text)


def remove_stopwords(tokens: Column, stopwords: list[str] | None = None) -> Column:
    listed = F.array(*[F.lit(w) for w in (stopwords or STOPWORDS_ENGLISH)])
    return F.filter(tokens, lambda t: ~F.array_contains(listed, F.lower(t)))


def ngrams(tokens: Column, n: int = 2) -> Column:
    last = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    out = F.slice(tokens, F.lit(1), last)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(tokens, F.lit(1 + j), last), lambda a, b: F.concat_ws(" ", a, b))
    return out


# ---- stemming ----------------------------------------------------------------


def porter_stem(word: str) -> str:
    """Porter's suffix stripping (Program 14(3), 1980)."""
    if len(word) <= 2 or not word.isascii():
        return word

    def cons(w, i):
        if w[i] in "aeiou":
            return False
        return True if w[i] != "y" or i == 0 else not cons(w, i - 1)

    def shape(w):
        runs = ""
        for i in range(len(w)):
            k = "c" if cons(w, i) else "v"
            runs += k if not runs or runs[-1] != k else ""
        return runs

    def measure(w):
        return shape(w).count("vc")

    def vowel(w):
        return any(not cons(w, i) for i in range(len(w)))

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and cons(w, len(w) - 1)

    def cvc(w):
        return len(w) > 2 and cons(w, len(w) - 3) and not cons(w, len(w) - 2) and cons(w, len(w) - 1) and w[-1] not in "wxy"

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # fixed values: suffix tables of steps 2 to 4
    two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    four = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    for table in (two, three):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(four, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Add ``stem``. Each distinct term is stemmed once and joined back."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(porter_stem)

    stems = terms.select(column).distinct().withColumn("stem", run(column))
    return terms.join(stems, column)


# ---- features ----------------------------------------------------------------


def text_features(df: DataFrame, text: str) -> DataFrame:
    """Counts per text and the ten most frequent words that are no stop words."""
    t = F.col(text)
    out = C.spread(df).withColumn("_w", words(clean_text(t)))
    w = F.col("_w")
    n, kinds = F.size(w), F.size(F.array_distinct(w))
    out = out.withColumns(
        {
            "character_count": F.length(t),
            "word_count": n,
            "sentence_count": F.size(sentences(t)),
            "avg_word_length": C.or_zero(C.ratio(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n)),
            "unique_words": kinds,
            "lexical_diversity": C.or_zero(C.ratio(kinds, n)),
            "uppercase_count": F.regexp_count(t, F.lit(r"\p{Lu}")),
            "digit_count": F.regexp_count(t, F.lit(r"\p{Nd}")),
            "punctuation_count": F.regexp_count(t, F.lit(r"[.,!?;:]")),
            "whitespace_count": F.regexp_count(t, F.lit(r"\s")),
        }
    )
    return out.drop("_w")


def common_words(df: DataFrame, key: list[str], text: str, top: int = 10) -> DataFrame:
    """Most frequent words per text without stop words."""
    # dealt by key once: counting and ranking then stay where a text is
    rows = df.select(*key, text).repartition(*key).select(*key, F.explode(words(clean_text(F.col(text)))).alias("word"))
    counts = rows.where(~F.lower("word").isin(STOPWORDS_ENGLISH)).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*key).orderBy(F.desc("cnt"), F.asc("word"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def preprocess(df: DataFrame, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """Clean text, its tokens without stop words, and the token count."""
    clean = clean_text(F.col(text))
    out = df.withColumn("clean", clean)
    return out.withColumn("tokens", remove_stopwords(words(F.col("clean")), stopwords)).withColumn("n_tokens", F.size("tokens"))


def preprocess_batch(df: DataFrame, text: str) -> DataFrame:
    return preprocess(df, text).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("total_tokens"), F.avg("n_tokens").alias("mean_tokens")
    )


def detect_script(df: DataFrame, text: str) -> DataFrame:
    """Share of Hangul among Latin and Hangul letters; above 0.3 is Korean."""
    hangul = F.regexp_count(F.col(text), F.lit("[가-힣]"))
    letters = F.regexp_count(F.col(text), F.lit("[a-zA-Z가-힣]"))
    out = df.withColumn("korean_ratio", C.or_zero(C.ratio(hangul, letters)))
    return out.withColumn("is_korean", F.col("korean_ratio") > 0.3)


def detect_language(df: DataFrame, key: list[str], text: str, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """Language whose function words make up the largest share of the words; Korean by script."""
    profiles = profiles or LANGUAGE_PROFILES
    rows = [(lang, w) for lang, ws in profiles.items() for w in ws]
    listed = F.broadcast(df.sparkSession.createDataFrame(rows, "language string, word string"))
    base = detect_script(df, text).select(*key, "korean_ratio", "is_korean", words(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " ")).alias("_w"))
    hits = base.select(*key, F.size("_w").alias("n"), F.explode("_w").alias("word")).join(listed, "word")
    share = hits.groupBy(*key, "language").agg((F.count(F.lit(1)) / F.max("n")).alias("share"))
    best = share.groupBy(*key).agg(F.min_by("language", F.struct(-F.col("share"), "language")).alias("_l"), F.max("share").alias("_s"))
    out = base.drop("_w").join(best, key, "left")
    language = F.when(F.col("is_korean"), "ko").otherwise(F.coalesce("_l", F.lit("unknown")))
    confidence = F.when(F.col("is_korean"), F.col("korean_ratio")).otherwise(F.coalesce("_s", F.lit(0.0)))
    return out.select(*key, language.alias("language"), confidence.alias("confidence"), "korean_ratio")


# ---- keywords ----------------------------------------------------------------


def term_tokens(text: Column) -> Column:
    """Lower-case words of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}{WORD}+)"), F.lit(1))
    return remove_stopwords(found)


def terms_1_2(tokens: Column) -> Column:
    return F.concat(tokens, ngrams(tokens, 2))


def token_column(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(key..., _t)``: lower-case words of two or more characters without stop words."""
    return cut_terms(C.spread(df.select(*key, text)), key, text)


def cut_terms(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """:func:`token_column` of rows that stay in the order and the partitions they have."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(rf"({WORD}{WORD}+)"), F.lit(1))
    base = df.select(*key, found.alias("_f"))
    # hash lookup of the stop words instead of one comparison per listed word
    return StopWordsRemover(inputCol="_f", outputCol="_t", stopWords=STOPWORDS_ENGLISH, locale="en_US").transform(base).select(*key, "_t")


def term_rows(df: DataFrame, key: list[str], text: str, two: bool = True) -> DataFrame:
    """``(key..., term)`` for every occurrence of a term."""
    base = token_column(df, key, text)
    return base.select(*key, F.explode(terms_1_2(F.col("_t")) if two else F.col("_t")).alias("term"))


def term_counts(df: DataFrame, key: list[str], text: str, two: bool = True) -> DataFrame:
    """``(key..., term, tf)``."""
    return term_rows(df, key, text, two).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _among(rows: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ``on`` columns are listed; missing values are equal."""
    names = listed.select([F.col(c).alias(f"_on{i}") for i, c in enumerate(on)])
    return rows.join(names, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)], "left_semi")


#: Terms share so many counters per label at first; those of the ``WIDE`` largest counters for each wanted term are counted one by one.
TERM_COUNTERS, WIDE = 1 << 16, 16


def frequent_terms(tokens: DataFrame, by: list[str], top: int) -> DataFrame:
    """``(by..., term, total)``: the ``top`` most frequent terms per label of ``(by..., term)`` occurrences, ties by term.

    A counter that terms share by their hash is at least as large as each of them. The terms of the largest counters are counted one by
    one, and the last of the best among these is a lower bound; terms of other counters are only counted if theirs reaches it.
    """
    dealt = tokens.select(*by, "term").withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(TERM_COUNTERS)).cast("int"))
    counters = stored(dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c")))
    taken = stored(top_values(counters, by, top * WIDE, [F.desc("_c"), F.asc("_b")]).drop("rank"))

    def best(listed: DataFrame) -> DataFrame:
        totals = _among(dealt, listed, [*by, "_b"]).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("total"))
        return stored(top_values(totals, by, top, [F.desc("total"), F.asc("term")]))

    found = best(taken)
    low = found.where(F.col("rank") == top).select(*[F.col(c).alias(f"_low_{c}") for c in by], F.col("total").alias("_low"))
    on = [F.col(c).eqNullSafe(F.col(f"_low_{c}")) for c in by]
    reach = counters.join(low, on or F.lit(True), "left").where(F.col("_c") >= F.coalesce("_low", F.lit(0))).select(counters.columns)
    rest = reach.exceptAll(taken)
    if not rest.isEmpty():
        found = best(stored(taken.unionByName(rest)))
    return found.drop("rank")


def keywords(df: DataFrame, key: list[str], text: str, top: int = 20, method: str = "tfidf", label: str | None = None) -> DataFrame:
    """Top terms by mean TF-IDF weight or count.

    The vocabulary is the ``top`` most frequent terms (per label when given);
    weights are L2-normalised inside each document over that vocabulary.
    """
    by = [label] if label else []
    tokens = term_rows(df, [*by, *key], text)
    vocab = stored(frequent_terms(tokens, by, top))
    # only the vocabulary's terms are counted by document
    held = _among(tokens, vocab, [*by, "term"])
    counts = stored(held.groupBy(*by, *key, "term").agg(F.count(F.lit(1)).alias("tf")))
    vocab = stored(counts.groupBy(*by, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")))
    if method == "count":
        return vocab.select(*by, "term", F.col("total").cast("double").alias("score"), "df")
    docs = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else df.agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    vocab = (vocab.join(docs, by) if by else vocab.crossJoin(docs)).withColumn("idf", idf)
    # the vocabulary has at most `top` rows per label
    small = F.broadcast(vocab) if not by else vocab
    weights = counts.join(small, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy(*by, *key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    rows = weights.join(norms, [*by, *key])
    return rows.groupBy(*by, "term").agg((F.sum(F.col("w") / F.col("norm")) / F.max("n")).alias("score"), F.max("df").alias("df"))


def keywords_by_class(df: DataFrame, key: list[str], text: str, label: str, top: int = 10, labels: int | None = None) -> DataFrame:
    """Keywords of every label, or of the ``labels`` most frequent ones."""
    if labels is None:
        return keywords(df, key, text, top, "tfidf", label)
    kinds = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), label).limit(labels).select(label)
    return keywords(df.join(F.broadcast(kinds), label), key, text, top, "tfidf", label)


def text_dataset_stats(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.avg(n).alias("avg_text_length"),
        F.avg(F.size(words(F.col(text)))).alias("avg_word_count"),
        F.max(n).cast("long").alias("max_text_length"),
        F.min(n).cast("long").alias("min_text_length"),
        F.stddev_pop(n).alias("std_text_length"),
    )


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, share)`` of a labelled text table; a missing label is one of its own."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


# ---- sentiment ---------------------------------------------------------------


def lexicon_frame(spark, lexicon: dict[str, float] | None = None) -> DataFrame:
    """A word list that the driver holds as a frame; up to a million words are broadcast."""
    words_ = lexicon or SENTIMENT
    frame = spark.createDataFrame(list(words_.items()), "word string, score double")
    return F.broadcast(frame) if len(words_) <= 1_000_000 else frame


def sentiment(df: DataFrame, key: list[str], text: str, lexicon: DataFrame | None = None, limit: float = 0.05) -> DataFrame:
    """Compound score s / sqrt(s^2 + 15) of the lexicon words per text; no hit is neutral."""
    lexicon = lexicon if lexicon is not None else lexicon_frame(df.sparkSession)
    found = words(F.regexp_replace(F.lower(F.col(text)), PUNCTUATION, " "))
    tokens = C.spread(df.select(*key, text)).select(*key, F.explode(found).alias("word"))
    hits = tokens.join(lexicon, "word")
    sums = hits.groupBy(*key).agg(F.sum("score").alias("_s"), F.count(F.lit(1)).alias("hits"))
    out = df.select(*key).join(sums, key, "left")
    s = F.coalesce("_s", F.lit(0.0))
    compound = s / F.sqrt(s * s + 15)
    out = out.withColumns({"score": compound, "hits": F.coalesce("hits", F.lit(0))})
    return out.withColumn(
        "sentiment", F.when(F.col("score") >= limit, "positive").when(F.col("score") <= -limit, "negative").otherwise("neutral")
    ).drop("_s")


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Counts, shares and score statistics; one row."""
    n = F.count(F.lit(1))
    kinds = ("positive", "negative", "neutral")
    counts = [F.count_if(F.col("sentiment") == k).alias(k) for k in kinds]
    shares = [(F.count_if(F.col("sentiment") == k) / n * 100).alias(f"{k}_pct") for k in kinds]
    basic = scored.agg(
        n.alias("n"), *counts, *shares, F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max")
    )
    med = O.exact_quantiles(scored, ["score"], {"median": 0.5}).select("median")
    m = F.col("mean")
    overall = F.when(m >= 0.05, "positive").when(m <= -0.05, "negative").otherwise("neutral")
    return basic.crossJoin(med).withColumn("overall", overall)


def sentiment_aspects(df: DataFrame, key: list[str], text: str, aspects: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    """Mean score of the sentences naming an aspect, with mentions and the first such sentence."""
    base = df.select(*key, F.posexplode(F.split(F.col(text), r"\.")).alias("_i", "sentence"))
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower("sentence"), F.lit(a.lower())), F.lit(a)) for a in aspects]))
    rows = base.select(*key, "_i", "sentence", F.explode(named).alias("aspect"))
    each = sentiment(base.join(rows.select(*key, "_i").distinct(), [*key, "_i"], "left_semi"), [*key, "_i"], "sentence", lexicon)
    joined = rows.join(each.select(*key, "_i", "score"), [*key, "_i"])
    out = joined.groupBy(*key, "aspect").agg(
        F.avg("score").alias("score"), F.count(F.lit(1)).alias("mentions"), F.min_by("sentence", "_i").alias("example")
    )
    return out.withColumn("sentiment", F.when(F.col("score") > 0.1, "positive").when(F.col("score") < -0.1, "negative").otherwise("neutral"))


# ---- entities ----------------------------------------------------------------


def entities(df: DataFrame, key: list[str], text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """``(key..., label, entity, start, stop)`` for every pattern match, positions in characters."""
    found = []
    t = F.col(text)
    for label, pattern in (patterns or ENTITY_PATTERNS).items():
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        gaps = F.split(t, pattern, -1)
        found.append(F.struct(F.lit(label).alias("label"), hits.alias("hits"), gaps.alias("gaps")))
    rows = C.spread(df.where(t.isNotNull()).select(*key, text)).select(*key, F.inline(F.array(*found))).where(F.size("hits") > 0)

    # running offset: gap, hit, gap, hit, ...
    zipped = F.zip_with(F.slice(F.col("gaps"), F.lit(1), F.size("hits")), "hits", lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<entity:string,start:int>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["g"]
        one = F.array(F.struct(x["h"].alias("entity"), begin.alias("start")))
        return F.struct((begin + F.length(x["h"])).alias("at"), F.concat(acc["out"], one).alias("out"))

    placed = rows.select(*key, "label", F.inline(F.aggregate(zipped, start, step, lambda acc: acc["out"])))
    return placed.withColumn("stop", F.col("start") + F.length("entity"))


def entities_dictionary(df: DataFrame, key: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """``(key..., label, entity, token)`` for dictionary words; ``dictionary`` has ``phrase`` and ``label``."""
    tokens = df.select(*key, F.posexplode(words(F.regexp_replace(F.lower(F.col(text)), PUNCTUATION, " "))).alias("token", "phrase"))
    hits = tokens.join(dictionary.select(F.lower("phrase").alias("phrase"), "label"), "phrase")
    return hits.select(*key, "label", F.col("phrase").alias("entity"), "token")


def _first_longest(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Which spans to take from left to right, each beginning where the one before has ended or later; spans come in order."""
    out = []
    for at, size in zip(starts, sizes):
        keep, end = [], 0
        for a, n in zip(at, size):
            keep.append(bool(a >= end))
            end = a + n if keep[-1] else end
        out.append(keep)
    return pd.Series(out)


def entities_phrases(df: DataFrame, key: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """``(key..., label, entity, token, n_tokens)`` for dictionary phrases of any number of words, leftmost and longest first.

    Words are compared in lower case without punctuation. Spans don't overlap; of several labels of one phrase the first counts.
    ``dictionary`` has ``phrase`` and ``label``; phrases without words are left out, and so are missing texts. Rows that share a key
    count as one text only if their spans are in the same place. Only words that begin some phrase are cut into windows, one for each
    length that phrases have.
    """
    entry = words(F.regexp_replace(F.lower("phrase"), PUNCTUATION, " "))
    known = dictionary.select(entry.alias("_w"), "label").where(F.size("_w") > 0)
    known = known.groupBy(F.array_join("_w", " ").alias("entity"), F.size("_w").alias("n")).agg(F.min("label").alias("label"))
    known = stored(known.withColumn("_first", F.substring_index("entity", " ", 1)))
    heads = known.groupBy("_first").agg(F.collect_set("n").alias("_sizes"))
    tokens = df.where(F.col(text).isNotNull()).select(*key, words(F.regexp_replace(F.lower(F.col(text)), PUNCTUATION, " ")).alias("_t"))
    longest = known.agg(F.max("n")).first()[0] or 1
    places = C.spread(tokens).select(*key, F.inline(F.transform("_t", lambda w, i: F.struct(w.alias("_first"), i.alias("token"), F.slice(F.col("_t"), i + 1, F.lit(longest)).alias("_next")))))
    begun = places.join(heads, "_first").select(*key, "token", "_next", F.explode("_sizes").alias("n")).where(F.size("_next") >= F.col("n"))
    spans = begun.select(*key, "token", "n", F.array_join(F.slice("_next", F.lit(1), F.col("n")), " ").alias("entity")).join(known.select("entity", "n", "label"), ["entity", "n"])
    ordered = F.array_sort(F.collect_list(F.struct("token", (-F.col("n")).alias("_neg"), "n", "label", "entity"))).alias("_s")
    rows = spans.groupBy(*key).agg(ordered)
    keep = F.pandas_udf(_first_longest, "array<boolean>")(F.col("_s.token"), F.col("_s.n"))
    taken = rows.withColumn("_k", keep).select(*key, F.inline(F.filter("_s", lambda x, i: F.get("_k", i))))
    return taken.select(*key, "label", "entity", "token", F.col("n").alias("n_tokens"))


def filter_entities(found: DataFrame, labels: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Entities of the given labels and at least the given confidence; found by rule they have 1.0 where there is no such column."""
    out = found.where(F.col("label").isin(labels)) if labels else found
    if min_confidence is None:
        return out
    confidence = F.col("confidence") if "confidence" in found.columns else F.lit(1.0)
    return out.where(confidence >= min_confidence)


def entity_frequencies(found: DataFrame, by: str = "label") -> DataFrame:
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("cnt"))


def entity_summary(found: DataFrame, top: int = 10) -> DataFrame:
    """Total and distinct counts per label with the most frequent entities."""
    counts = found.groupBy("label", "entity").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("label").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    best = top_values(counts, ["label"], top, [F.desc("cnt"), F.asc("entity")])
    return best.join(totals, "label")
