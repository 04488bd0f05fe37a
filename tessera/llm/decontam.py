"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

The index is a table of postings (term, document, position) of all documents for the terms that occur in the
benchmark, each written segment sorted by term, and a posting END at each document's word count.  A test window's
terms are ranked by the index's counts; the postings of its two rarest, moved back by their offsets in the window, are
intersected on (document, start); what is left is intersected with the postings of its other terms.  Starts found for
all offsets are exact phrase matches (`matches`).  `near` lets each term lie some words from its place instead, the places
counted from an occurrence of the rarest; one occurrence may serve equal terms.  Those that are off by nothing are the exact
matches, so the report takes both from it.

Test tables are broadcast only while they take BROADCAST bytes at most (they are measured first); beyond it the same joins
shuffle.

Words: runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lowered.  A window is `width` consecutive words of
an item; an item of fewer words, but not none, is one window.

Edge cases: null and empty texts have no words; items without words have no windows; equal windows of several items count
for each; rows whose keys repeat or are null, and keys that are no whole numbers, are numbered first (`numbered`), so each
row has the hits of its own text; items without an id are left out, repeated items count once; texts of any length are
indexed whole; empty tables give no hits; no tie decides anything; other columns are left out of the report, whatever
their names, and pass through `clean`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered, small

__all__ = ["Index", "Tests", "build", "clean", "matches", "near", "report", "tests_of"]

WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words; upper case A-Z belongs to them.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = ""


def raw_words(text: Column) -> Column:
    """Splitting leaves an empty string at most before and after the words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lowered(word: Column) -> Column:
    """Only A-Z change; the quick function does just that to ASCII words."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


@dataclass
class Tests:
    windows: DataFrame  # wid, n, off, tid
    items: DataFrame  # item_id, wid
    vocabulary: DataFrame  # term, tid


@dataclass
class Index:
    postings: DataFrame  # tid, doc, pos
    ends: DataFrame  # doc, n_words
    rows: DataFrame | None  # doc, key, text, where numbers of rows are other than the keys

    def keyed(self, df: DataFrame, key: str) -> DataFrame:
        """df with the key in place of doc."""
        named = df.withColumnRenamed("doc", key) if self.rows is None else self.rows.select("doc", F.col("key").alias(key)).join(df, "doc").drop("doc")
        return named.select(key, *[c for c in df.columns if c != "doc"])


def tests_of(benchmark: DataFrame, scratch: Scratch, width: int = WIDTH, item: str = "item_id", text: str = "text") -> Tests:
    words = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), F.transform(raw_words(F.col(text)), lowered).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, F.lit(width)))).alias("w")).distinct()
    distinct = scratch.save(each.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w"), "windows")
    items = scratch.save(each.join(distinct, "w").select("item_id", "wid"), "items")
    flat = distinct.select("wid", F.size("w").alias("n"), F.posexplode("w").alias("off", "term"))
    vocabulary = scratch.save(flat.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    windows = scratch.save(flat.join(vocabulary, "term").select("wid", "n", "off", "tid"), "terms")
    return Tests(windows, items, vocabulary)


def build(docs: DataFrame, tests: Tests, scratch: Scratch, key: str = "doc_id", text: str = "text") -> Index:
    """Postings of all documents for the tests' terms."""
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _index(numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), scratch, pieces), tests, scratch)


def _index(rows: DataFrame, tests: Tests, scratch: Scratch) -> Index:
    spark = rows.sparkSession
    ended = F.concat(raw_words(F.col("text")), F.array(F.lit(END)))
    each = rows.select("doc", F.posexplode(ended).alias("pos", "word")).select("doc", "pos", lowered(F.col("word")).alias("term"))
    end = spark.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("long").alias("tid"))
    known = scratch.save(tests.vocabulary.unionByName(end), "terms-and-end")
    found = each.join(small(known, F.octet_length("term") + 8), "term").select("tid", "doc", "pos")
    postings = scratch.save(found.sortWithinPartitions("tid", "doc", "pos"), "postings")
    return Index(postings.where("tid >= 0"), postings.where("tid = -1").select("doc", F.col("pos").cast("long").alias("n_words")), rows if hasattr(rows, "_tessera_path") else None)


def _rarest(index: Index, tests: Tests, scratch: Scratch) -> DataFrame:
    """The windows' terms with their place in the order from rare to frequent."""
    counts = index.postings.groupBy("tid").count()
    ranked = tests.windows.join(counts, "tid", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    order = Window.partitionBy("wid").orderBy("count", "off")
    return scratch.save(ranked.select("wid", "n", "off", "tid", F.row_number().over(order).alias("place"), F.min("count").over(Window.partitionBy("wid")).alias("least")).where("least > 0"), "rarest")


def matches(index: Index, tests: Tests, scratch: Scratch) -> DataFrame:
    """doc, wid, start, n: every exact occurrence of every window."""
    rarest = _rarest(index, tests, scratch)
    bit = F.expr("shiftleft(1L, off)")
    first = small(rarest.where("place <= 2").select("wid", "n", "off", "tid"), 24)
    moved = index.postings.join(first, "tid").select("wid", "n", "doc", (F.col("pos") - F.col("off")).alias("start"), bit.alias("bit")).where("start >= 0")
    both = moved.groupBy("wid", "n", "doc", "start").agg(F.expr("bit_or(bit)").alias("mask")).where("bit_count(mask) = least(n, 2)")
    both = scratch.save(both, "pairs")
    rest = small(rarest.where("place > 2").select("wid", "off", "tid"), 20)
    asked = both.where("n > 2").join(rest, "wid").select("wid", "doc", "start", (F.col("start") + F.col("off")).alias("pos"), "tid", bit.alias("bit"))
    held = both.where("n > 2").select("doc").distinct()
    there = index.postings.join(small(scratch.save(held, "held"), 8), "doc", "left_semi")
    more = asked.join(there, ["doc", "pos", "tid"]).select("wid", "doc", "start", "bit")
    got = more.groupBy("wid", "doc", "start").agg(F.expr("bit_or(bit)").alias("more"))
    whole = both.join(got, ["wid", "doc", "start"], "left").where("(mask | coalesce(more, 0)) = shiftleft(1L, n) - 1")
    return whole.select("doc", "wid", "start", "n")


def near(index: Index, tests: Tests, scratch: Scratch, slop: int = 3) -> DataFrame:
    """doc, wid, start, off_by: all of a window's terms at most `slop` words from their places; off_by is how far the farthest is, each taken at its nearest."""
    rarest = _rarest(index, tests, scratch)

    def moved(place: int, name: str) -> DataFrame:
        terms = small(rarest.where(F.col("place") == place).select("wid", "n", "off", "tid"), 24)
        return index.postings.join(terms, "tid").select("wid", "n", "doc", (F.col("pos") - F.col("off")).alias(name))

    a = moved(1, "start").withColumn("cell", F.floor(F.col("start") / (slop + 1)))
    b = moved(2, "other").drop("n").withColumn("cell", F.explode(F.array(*[F.floor(F.col("other") / (slop + 1)) + d for d in (-1, 0, 1)])))
    off = F.abs(F.col("other") - F.col("start"))
    pairs = a.join(b, ["wid", "doc", "cell"]).where(off <= slop).groupBy("wid", "n", "doc", "start").agg(F.min(off).alias("off_by"))
    single = a.where("n = 1").select("wid", "n", "doc", "start", F.lit(0).alias("off_by")).distinct()
    both = scratch.save(pairs.unionByName(single), "near-pairs")
    rest = small(rarest.where("place > 2").select("wid", "off", "tid"), 20)
    around = F.explode(F.sequence(F.col("start") + F.col("off") - slop, F.col("start") + F.col("off") + slop))
    asked = both.where("n > 2").join(rest, "wid").select("wid", "doc", "start", "off", "tid", around.alias("pos"))
    held = scratch.save(both.where("n > 2").select("doc").distinct(), "near-held")
    there = index.postings.join(small(held, 8), "doc", "left_semi")
    each = asked.join(there, ["doc", "pos", "tid"]).groupBy("wid", "doc", "start", "off").agg(F.min(F.abs(F.col("pos") - F.col("start") - F.col("off"))).alias("by"))
    got = each.groupBy("wid", "doc", "start").agg(F.max("by").alias("by"), F.count("*").alias("held"))
    whole = both.join(got, ["wid", "doc", "start"], "left").where("n <= 2 OR held = n - 2")
    return whole.select("doc", "wid", "start", F.greatest("off_by", F.coalesce("by", F.lit(0))).alias("off_by"))


def report(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = WIDTH, key: str = "doc_id", text: str = "text", slop: int = 3) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with proximity matches, exact ones included) of every document."""
    tests = tests_of(benchmark, scratch, width)
    index = build(docs, tests, scratch, key, text)
    found = scratch.save(near(index, tests, scratch, slop).join(tests.windows.select("wid", "n").distinct(), "wid"), "found")
    exact = found.where("off_by = 0")
    spots = exact.select("doc", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    of_items = found.groupBy("doc", "wid").agg((F.min("off_by") == 0).alias("exact")).join(tests.items, "wid")
    name = F.col("item_id").cast("string")
    items = of_items.groupBy("doc").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), name))).alias("items"), F.count_distinct(name).alias("n_near"))
    none = F.array().cast("array<string>")
    out = index.ends.join(items.join(spots, "doc", "left"), "doc", "left").withColumn("items", F.coalesce("items", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    out = out.select(
        "doc", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    return index.keyed(out, key)


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    tests = tests_of(benchmark, scratch, width)
    pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row")), scratch, pieces)
    index = _index(rows, tests, scratch)
    gone = scratch.save(matches(index, tests, scratch).select("doc").distinct(), "gone")
    scratch.keep_only(gone, *([rows] if index.rows is not None else []))
    return rows.join(gone, "doc", "left_anti").select("row.*")
