r"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Of every window of
13 consecutive words the smallest of its eight 6-gram hashes is the fingerprint, so equal windows have
equal fingerprints: every shared span of 13 words or more is found, whatever stands around it.

1. Fingerprints of the documents are joined with those of the benchmark; documents with a common one
   are candidates.
2. Candidates are extended: each of their windows is held against the benchmark's windows, on
   fingerprint and words. The union of the windows found gives the words that are hit.

Benchmark items of fewer than 13 words, but not none, are one window as a whole; each such length
is looked up with windows of that length.

Null texts have no words; they are never contaminated. Items whose id is null mark words, but are not
counted in n_items. Repeated rows each get their result; rows with one id and different texts are kept
apart. Further columns are ignored by ``report`` and carried on by ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenkeel.sources.scratch import materialise

#: Words of a window; of a gram; grams of a window.
WINDOW, GRAM = 13, 6
#: A side of a join is broadcast up to so many rows (some tens of MB), counted before; beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # lower() is the faster of the two and does the same to texts of ASCII only
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _zipped(df: DataFrame, out: str, a: str, b: str, shift: int, length: Column, join) -> DataFrame:
    """``out[i] = join(a[i], b[i + shift])`` for ``length`` values of i (none if that is negative)."""
    length = F.greatest(F.lit(0), length)
    return df.withColumn(out, F.zip_with(F.slice(a, 1, length), F.slice(b, shift + 1, length), join))


def winnowed(df: DataFrame) -> DataFrame:
    """``df`` (with ``words``) with ``picked``: the fingerprint of each window."""
    n = F.size("words")
    both = lambda a, b: F.xxhash64(a, b)
    low = lambda a, b: F.least(a, b)
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(w)))
    df = _zipped(df, "g2", "g1", "g1", 1, n - 1, both)
    df = _zipped(df, "g4", "g2", "g2", 2, n - 3, both)
    df = _zipped(df, "g6", "g4", "g2", 4, n - 5, both)
    df = _zipped(df, "m2", "g6", "g6", 1, n - 6, low)
    df = _zipped(df, "m4", "m2", "m2", 2, n - 8, low)
    df = _zipped(df, "picked", "m4", "m4", 4, n - 12, low)
    return df.drop("g1", "g2", "g4", "g6", "m2", "m4")


def windows(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """A row for each window of ``length`` words: start, span (its words), and the columns ``keep``."""
    rows = df.filter(F.size("words") >= length).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start"))
    picked = [F.element_at("picked", F.col("start") + 1).alias("print")] if "picked" in df.columns else []
    return rows.select(*keep, "start", *picked, F.array_join(F.slice("words", F.col("start") + 1, length), " ").alias("span"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text_hash (with the id, a row's identity), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text_hash"), text.alias("text"))


def _report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """As ``report``, with _text_hash."""
    items = benchmark.select(F.col(item_col).alias("_item"), words(F.coalesce(F.col(item_text_col), F.lit(""))).alias("words")).filter(F.size("words") > 0)
    whole = F.size("words") < WINDOW
    long_spans = windows(winnowed(items.filter(~whole)), WINDOW, "_item")
    short_spans = items.filter(whole).select("_item", F.lit(0).alias("start"), F.lit(None).cast("long").alias("print"), F.array_join("words", " ").alias("span"))
    held = materialise(
        long_spans.select("_item", "print", "span", F.lit(WINDOW).alias("length")).unionByName(
            short_spans.select("_item", "print", "span", (F.size(F.split("span", " "))).alias("length"))
        ).distinct()
    )
    spans = held.select("print", "span", "length").distinct()
    n_spans = spans.count()
    short_lengths = [r[0] for r in held.filter(F.col("length") < WINDOW).select("length").distinct().collect()]  # 12 at most

    keyed = _keyed(docs, id_col, text_col)
    cut = keyed.select("_id", "_text_hash", words(F.col("text")).alias("words"))
    # One pass over the texts: each row's number of words, and whether it has a common fingerprint.
    prints = spans.filter(F.col("length") == WINDOW).select("print", F.lit(1).alias("_in")).distinct()
    counted = cut.select("*", F.monotonically_increasing_id().alias("_row"))
    picked = winnowed(counted).select("_row", "_id", "_text_hash", F.size("words").alias("n_words"), F.explode_outer(F.array_distinct("picked")).alias("print"))
    # Rows without a window are dealt evenly; should one meet a fingerprint by chance, the words decide below.
    picked = picked.withColumn("print", F.coalesce("print", F.xxhash64("_row"))).join(_small(prints, n_spans), "print", "left")
    base = materialise(picked.groupBy("_row", "_id", "_text_hash", "n_words").agg(F.max("_in").alias("_in")))
    found = base.filter("_in = 1").select(F.col("_id").alias("_found"), F.col("_text_hash").alias("_found_hash")).distinct()
    n_found = found.count()
    same = keyed["_id"].eqNullSafe(found["_found"]) & (keyed["_text_hash"] == found["_found_hash"])
    candidates = keyed.join(_small(found, n_found), same, "left_semi").select("_id", "_text_hash", words(F.col("text")).alias("words")).filter(F.size("words") >= WINDOW)
    key = ["_id", "_text_hash"]
    wide = windows(winnowed(candidates), WINDOW, *key).withColumn("length", F.lit(WINDOW))
    hits = wide.join(_small(spans, n_spans), ["print", "span", "length"], "left_semi").select(*key, "start", "length", "span")
    for length in short_lengths:
        narrow = windows(cut, length, *key).withColumn("length", F.lit(length))
        at = spans.filter(F.col("length") == length).select("span")
        hits = hits.unionByName(narrow.join(_small(at, n_spans), "span", "left_semi").select(*key, "start", "length", "span"))
    hits = materialise(hits.distinct())

    before = W.partitionBy(*key).orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    covered = hits.withColumn("_new", new).groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    owners = hits.select(*key, "span").distinct().join(_small(held.select("_item", "span").distinct(), n_spans), "span").select(*key, F.col("_item").cast("string").alias("_item")).distinct()
    listed = owners.groupBy(*key).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    listed = listed.select(F.col("_id").alias("_i"), F.col("_text_hash").alias("_h"), "_items")
    summary = covered.join(listed, covered["_id"].eqNullSafe(listed["_i"]) & (covered["_text_hash"] == listed["_h"]), "left").select(
        F.col("_id").alias("_i2"), F.col("_text_hash").alias("_h2"), "n_hit", "_items"
    )
    out = base.join(summary, base["_id"].eqNullSafe(summary["_i2"]) & (base["_text_hash"] == summary["_h2"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed_items = F.coalesce("_items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        "_text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """A row per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _report(docs, benchmark, id_col, text_col, **columns).drop("_text_hash")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    bad = _report(docs, benchmark, id_col, text_col, **columns).filter("contaminated")
    bad = materialise(bad.select(F.col(id_col).alias("_bad"), F.col("_text_hash").alias("_bad_hash")).distinct())
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(_small(bad, bad.count()), docs[id_col].eqNullSafe(bad["_bad"]) & (text_hash == bad["_bad_hash"]), "left_anti")
