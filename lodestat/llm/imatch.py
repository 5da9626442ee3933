"""Document fingerprints by I-Match, with DataFrame functions alone.

A lexicon holds the terms whose document frequency, as a share of all documents, lies in a band: neither in nearly every document nor
in a handful. Being in at least ``LOW`` of all documents bounds it: there can be no more such terms than the mean number of distinct
terms per document divided by ``LOW``, whatever the size of the corpus. The lexicon is drawn into several random subsets of various
sizes; for each the distinct terms of a document that fall into it are sorted and hashed. Small subsets survive edits, large ones tell
documents apart. The likeness of two fingerprints is the share of subsets, out of those not empty on both sides, with equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import materialise, whole_text

#: Band of document frequency as a share of all documents.
LOW, HIGH = 0.002, 0.2
#: One in so many lexicon terms is drawn into a subset; each rate is used ``DRAWS`` times.
RATES, DRAWS = (6, 30, 150, 750), 6
N_SUBSETS = len(RATES) * DRAWS


def distinct_terms(text: Column) -> Column:
    """Distinct words of the lower-cased text, parted by anything but letters, digits and combining marks."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term`` of the band, over all documents. Its size is bounded by the mean number of distinct terms divided by ``low``."""
    n = docs.count()
    terms = docs.select(F.explode(distinct_terms(whole_text(text))).alias("term")).where("term <> ''")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= max(2, high * n))).select("term")


def subset_hash(hits: Column, subset: int, rate: int) -> Column:
    """Hash of the sorted term hashes that the subset draws, "-" if there are none."""
    drawn = F.filter(hits, lambda h: F.pmod(F.xxhash64(h, F.lit(subset)), F.lit(rate)) == 0)
    return F.when(F.size(drawn) > 0, F.substring(F.hex(F.xxhash64(drawn)), -8, 8)).otherwise(F.lit("-"))


def fingerprint(head: Column, hits: Column) -> Column:
    """Hex hashes joined by ".": one of all distinct terms, then one per lexicon subset."""
    parts = [subset_hash(hits, r * DRAWS + i, rate) for r, rate in enumerate(RATES) for i in range(DRAWS)]
    return F.concat_ws(".", F.lpad(F.hex(head), 16, "0"), *parts)


def fingerprints(rows: DataFrame, terms: DataFrame, keys: list[str], texts: dict[str, str], carry: list[str]) -> DataFrame:
    """``keys``, ``carry`` columns and a fingerprint per text column of ``texts`` (text column to name).

    ``keys`` must tell rows apart; if ``rows`` is dealt by some of them nothing is shuffled. ``terms`` (the lexicon) is broadcast. The
    carried columns ride on one extra row per document.
    """
    bags = {name: f"__{name}" for name in texts.values()}
    rows = rows.select(*keys, *carry, *[distinct_terms(F.col(c)).alias(bags[name]) for c, name in texts.items()])
    heads = [F.xxhash64(F.array_sort(bags[name])).alias(name) for name in texts.values()]
    info = F.struct(*[F.col(c) for c in carry], *heads)
    empty = F.lit(None).cast("string")
    items = [F.array(F.struct(empty.alias("term"), F.lit(-1).alias("side"), info.alias("info")))]
    for side, name in enumerate(texts.values()):
        rest = F.struct(F.lit(side).alias("side"), F.when(F.lit(False), info).alias("info"))
        items.append(F.transform(bags[name], _with(rest)))
    long = rows.select(*keys, F.explode(F.concat(*items)).alias("item")).select(*keys, "item.term", "item.side", "item.info")
    found = long.join(F.broadcast(terms.withColumn("__in", F.lit(True))), "term", "left").where("__in OR side < 0")
    found = found.select(*keys, "side", F.when(F.col("side") >= 0, F.xxhash64("term")).alias("h"), "info")
    hits = [F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("h")))).alias(f"__h{side}") for side in range(len(texts))]
    out = found.groupBy(*keys).agg(F.first("info", ignorenulls=True).alias("info"), *hits)
    made = [fingerprint(F.col(f"info.{name}"), F.col(f"__h{side}")).alias(name) for side, name in enumerate(texts.values())]
    return out.select(*keys, *[F.col(f"info.{c}").alias(c) for c in carry], *made)


def _with(rest: Column):
    """A function of one argument, as ``transform`` asks for."""
    return lambda term: F.struct(term.alias("term"), rest["side"].alias("side"), rest["info"].alias("info"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts, out of those not empty in both, from 0 to 1."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    pairs = F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-"))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.size(pairs)


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form: the last third replaced by the beginning of the next document.

    The next document is the one with the next smaller key; after the smallest comes the largest. Of equal keys the order is that of
    the texts' hashes; missing keys come last. Missing texts are empty. Returns ``key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; other columns are ignored; an empty table gives no rows. A lone document is its own
    next. Keys are whole numbers: rows are dealt to about sqrt(n) key ranges of equal width, so a text moves once.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), whole_text(text).alias("body"))
    size = source.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    n, low, high = size["n"], size["low"] or 0, size["high"] or 0
    ranges = max(1, int(n**0.5))
    terms = materialise(lexicon(docs, text))
    width = max(1, -(-(high - low + 1) // ranges))
    # nulls in the last range of the descending order
    source = source.withColumn("cell", F.coalesce(F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long")))
    source = source.withColumn("tie", F.xxhash64("body"))
    order = Window.partitionBy("cell").orderBy(F.desc_nulls_last("id"), "tie", F.xxhash64("body", F.lit(1)))
    firsts = source.groupBy("cell").agg(F.max_by("body", F.struct("id", -F.col("tie").cast("decimal(20,0)"))).alias("first_body"))
    firsts = materialise(firsts)
    follow = Window.orderBy(F.desc("cell"))  # about sqrt(n) rows
    chain = firsts.select("cell", F.lead("cell").over(follow).alias("next_cell"), F.first("cell").over(follow).alias("top"))
    chain = materialise(chain.select("cell", F.coalesce("next_cell", "top").alias("next_cell")))
    after = chain.join(firsts.select(F.col("cell").alias("next_cell"), "first_body"), "next_cell").select("cell", "first_body")
    rows = source.withColumns({"place": F.row_number().over(order).cast("long"), "next_body": F.lead("body").over(order)})
    rows = rows.join(after, "cell").withColumn("next_body", F.coalesce("next_body", "first_body"))
    chars = F.char_length("body").cast("long")
    take = F.floor(chars / 3).cast("int")
    edited = F.concat(F.left("body", F.char_length("body") - take), F.left("next_body", take))
    rows = rows.select("cell", "place", F.col("id"), chars.alias("n_chars"), "body", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    prints = fingerprints(rows, terms, ["cell", "place"], {"body": "fingerprint", "edited": "edited_fingerprint"}, ["id", "n_chars", "edited_sha256"])
    prints = materialise(prints)
    head = prints.where("place = 1").select(F.col("cell").alias("next_cell"), F.col("fingerprint").alias("first_print"))
    after = chain.join(head, "next_cell").select("cell", "first_print")
    out = prints.withColumn("next_print", F.lead("fingerprint").over(Window.partitionBy("cell").orderBy("place"))).join(after, "cell")
    return out.select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_print", "first_print")).alias("near_next"),
    )
