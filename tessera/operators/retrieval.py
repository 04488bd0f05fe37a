"""Two-stage TF-IDF candidate retrieval as inverted-index joins, candidate augmentation and negative mining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.nearest import Stage, merge, nearest

DIGITS = 6
#: Pairs of postings up to which a join of all of them is taken, instead of one that leaves out what cannot reach the best.
DIRECT = 200_000_000


def word_terms(x: Column) -> Column:
    """Words of two or more characters, and pairs of neighbouring ones."""
    w = F.filter(F.split(x, " "), lambda t: F.length(t) >= 2)
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(w, F.coalesce(pairs, F.array().cast("array<string>")))


def char_terms(x: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of words with a blank on both sides; a short word counts once."""

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))

        def of(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.length(padded) - n + 1)
            return F.when(F.length(padded) > n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array(padded))

        each = [of(n) for n in sizes]
        short = F.length(padded) <= min(sizes)
        return F.when(short, F.array(padded)).otherwise(F.concat(*each))

    return F.flatten(F.transform(F.filter(F.split(x, " "), lambda t: t != ""), grams))


def weigh(docs: DataFrame, terms: Column, min_df: int = 2, max_df: float = 0.02, max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of docs(country, id, x): vocabulary has (country, term, idf), weights (country, id, term, w).

    A small corpus relaxes the bounds: below min_df rows a term may occur once, and a max_df share under min_df rows
    excludes nothing.
    """
    tf = docs.select("country", "id", F.explode(terms).alias("term")).groupBy("country", "id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("country", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    vocabulary = _bounded(df, docs, min_df, max_df, max_features)
    return vocabulary, scale(tf, vocabulary)


def vocabulary(docs: DataFrame, terms: Callable[[Column], Column], min_df: int = 2, max_df: float = 0.02, max_features: int | None = None) -> DataFrame:
    """The vocabulary of weigh(docs, terms(x)); documents are shuffled as texts, and of terms only counts by task."""
    every = F.flatten(F.transform("x", lambda x: terms(x)))
    each = F.transform(F.array_distinct(every), lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("all")))
    if max_features:
        each = F.concat(each, F.transform(every, lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("all"))))
    df = merge(docs).select("country", F.explode(each).alias("t")).groupBy("country", "t.term").agg(F.sum("t.df").alias("df"), F.sum("t.all").alias("all"))
    return _bounded(df, docs, min_df, max_df, max_features)


def _bounded(df: DataFrame, docs: DataFrame, min_df: int, max_df: float, max_features: int | None) -> DataFrame:
    """(country, term, idf) of the terms within the bounds."""
    size = docs.groupBy("country").agg(F.count("*").alias("total"))
    least = F.when(F.col("total") < min_df, 1).otherwise(min_df)
    most = F.when(F.col("total") * max_df < min_df, F.col("total") * 1.0).otherwise(F.col("total") * max_df)
    # A row per country: its number is that of countries, not of documents.
    kept = df.join(size, "country").where((F.col("df") >= least) & (F.col("df") <= most))
    if max_features:
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("all"), "term"))).where(F.col("place") <= max_features)
    return kept.select("country", "term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))


def scale(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    raw = tf.join(vocabulary, ["country", "term"]).select("country", "id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("country", "id")))
    return raw.select("country", "id", "term", (F.col("raw") / norm).alias("w"))


def weigh_queries(docs: DataFrame, terms: Column, vocabulary: DataFrame) -> DataFrame:
    tf = docs.select("country", "id", F.explode(terms).alias("term")).groupBy("country", "id", "term").agg(F.count("*").alias("tf"))
    return scale(tf, vocabulary)


def cosine(queries: DataFrame, targets: DataFrame, shortlist: DataFrame | None = None) -> DataFrame:
    """(s1_id, target_id, score) of pairs that share a term, or of the shortlist's pairs among them."""
    q = queries.select("country", "term", F.col("id").alias("s1_id"), F.col("w").alias("wq"))
    t = targets.select("country", "term", F.col("id").alias("target_id"), F.col("w").alias("wt"))
    if shortlist is not None:
        pairs = shortlist.select("s1_id", "target_id").join(q, "s1_id").join(t, ["target_id", "country", "term"])
    else:
        pairs = q.join(t, ["country", "term"])
    return pairs.groupBy("s1_id", "target_id").agg(F.round(F.sum(F.col("wq") * F.col("wt")), DIGITS).alias("score"))


def top(scores: DataFrame, k: int, least: float | None = None) -> DataFrame:
    if least is not None:
        scores = scores.where(F.col("score") >= least)
    order = Window.partitionBy("s1_id").orderBy(F.desc("score"), "target_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coarse(queries: DataFrame, targets: DataFrame, k: int, direct: int = DIRECT) -> DataFrame:
    """The k best targets of each query by cosine: top(cosine(queries, targets), k).

    With more than `direct` pairs of postings, most of them are never joined.  A query's terms are taken from rare to
    frequent; the score of its k-th best target by the first terms is one that all k best reach at least.  Terms whose largest
    possible scores together stay under it (what is frequent, mostly) bring no target in; they only add to targets that
    others brought in.
    """
    stats = targets.groupBy("country", "term").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    asked = queries.join(stats, ["country", "term"])
    if (asked.agg(F.sum("df")).first()[0] or 0) <= direct:
        return top(cosine(queries, targets), k)
    order = Window.partitionBy("country", "id").orderBy("df", "term")
    onward, sofar = order.rowsBetween(Window.currentRow, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    bounded = asked.select(
        "country", "term", F.col("id").alias("s1_id"), F.col("w").alias("wq"), F.sum(F.col("w") * F.col("most")).over(onward).alias("reach"), F.coalesce(F.sum("df").over(sofar), F.lit(0)).alias("before")
    )
    t = targets.select("country", "term", F.col("id").alias("target_id"), F.col("w").alias("wt"))

    def scores(terms: DataFrame) -> DataFrame:
        return terms.join(t, ["country", "term"]).groupBy("country", "s1_id", "target_id").agg(F.sum(F.col("wq") * F.col("wt")).alias("part"))

    place = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("part")))
    floor = scores(bounded.where(F.col("before") < 4 * k)).withColumn("place", place).where(F.col("place") == k).select("s1_id", (F.col("part") - 10.0**-DIGITS).alias("floor"))
    marked = bounded.join(floor, "s1_id", "left").withColumn("leads", F.col("floor").isNull() | (F.col("reach") >= F.col("floor")))
    rest = marked.where(~F.col("leads"))
    slack = rest.groupBy("s1_id").agg(F.max("reach").alias("slack"), F.first("floor").alias("floor"))
    found = scores(marked.where("leads")).join(slack, "s1_id", "left").where("slack IS NULL OR part + slack >= floor")
    more = found.where("slack IS NOT NULL").select("country", "s1_id", "target_id").join(rest.select("country", "s1_id", "term", "wq"), ["country", "s1_id"]).join(t, ["country", "term", "target_id"])
    more = more.groupBy("s1_id", "target_id").agg(F.sum(F.col("wq") * F.col("wt")).alias("more"))
    whole = found.join(more, ["s1_id", "target_id"], "left").select("s1_id", "target_id", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), DIGITS).alias("score"))
    return top(whole, k)


def in_several(s1: DataFrame) -> bool:
    """Whether an id stands in more than one country."""
    return not s1.groupBy("id").agg(F.min("country").alias("a"), F.max("country").alias("b")).where("a <> b").isEmpty()


def words(targets: DataFrame, max_df: float) -> Stage:
    return Stage("words", vocabulary(targets, word_terms, max_df=max_df))


def grams(targets: DataFrame, max_df: float, max_features: int | None = 150_000) -> Stage:
    return Stage("chars", vocabulary(targets, char_terms, max_df=max_df, max_features=max_features))


def shortlist(s1: DataFrame, targets: DataFrame, k: int = 300, max_df: float = 0.02) -> DataFrame:
    """(s1_id, target_id, score, rank) by words and pairs of words.  Inputs have (country, id, x)."""
    if in_several(s1):
        terms = word_terms(F.col("x"))
        vocabulary, weights = weigh(targets, terms, max_df=max_df)
        return coarse(weigh_queries(s1, terms, vocabulary), weights, k)
    return nearest(s1, targets, [words(targets, max_df)], k)


def by_characters(s1: DataFrame, targets: DataFrame, short: DataFrame | None, max_df: float = 0.25, max_features: int | None = 150_000) -> DataFrame:
    """(s1_id, target_id, score): character cosine of the shortlist's pairs, or of all pairs without one."""
    vocabulary, weights = weigh(targets, char_terms(F.col("x")), max_df=max_df, max_features=max_features)
    return cosine(weigh_queries(s1, char_terms(F.col("x")), vocabulary), weights, short)


def rescored(s1: DataFrame, targets: DataFrame, coarse: int = 300, word_max_df: float = 0.02, char_max_df: float = 0.25, fine: int | None = None, least: float | None = None) -> DataFrame:
    """(s1_id, target_id, score, rank): word shortlist by character cosine, all of it that shares an n-gram or the `fine` best of at least `least`."""
    if in_several(s1):
        return top(by_characters(s1, targets, shortlist(s1, targets, coarse, word_max_df), char_max_df), 1 << 30 if fine is None else fine, least)
    return nearest(s1, targets, [words(targets, word_max_df), grams(targets, char_max_df)], coarse, fine, least)


def candidates(s1: DataFrame, targets: DataFrame, coarse: int = 300, fine: int = 20, least: float = 0.10, word_max_df: float = 0.02, char_max_df: float = 0.25) -> DataFrame:
    """(s1_id, target_id, score, rank): word shortlist, reordered by character cosine.  Inputs have (country, id, x)."""
    return rescored(s1, targets, coarse, word_max_df, char_max_df, fine, least)


def exact_candidates(s1: DataFrame, targets: DataFrame, fine: int = 20, least: float = 0.10, char_max_df: float = 0.25) -> DataFrame:
    """What candidates() would give if every target were in the shortlist: all pairs that share an n-gram are scored."""
    if in_several(s1):
        return top(by_characters(s1, targets, None, char_max_df), fine, least)
    return nearest(s1, targets, [grams(targets, char_max_df)], fine, least=least)


def compare(found: DataFrame, exact: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: mean recall and Jaccard of found against exact candidates, and the share of entities with equal lists, in %."""
    ids = lambda df, name: df.groupBy("s1_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda x: x["target_id"]).alias(name))
    none = F.array().cast("array<string>")
    both = entities.select("s1_id").join(ids(found, "a"), "s1_id", "left").join(ids(exact, "b"), "s1_id", "left").select(F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    shared, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    recall = F.when(F.size("b") > 0, shared / F.size("b")).otherwise(1.0)
    jaccard = F.when(either > 0, shared / either).otherwise(1.0)
    return both.agg(F.count("*").alias("queries"), F.round(100 * F.avg(recall), 6).alias("recall"), F.round(100 * F.avg(jaccard), 6).alias("jaccard"), F.round(100 * F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("same"))


def augment_by_code(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, target_id) with equal postal codes; inputs have (id, code)."""
    return s1.where("code is not null").select(F.col("id").alias("s1_id"), "code").join(targets.where("code is not null").select(F.col("id").alias("target_id"), "code"), "code").select("s1_id", "target_id").distinct()


def augment_by_tokens(s1: DataFrame, targets: DataFrame, least: int = 2, cap: int | None = 60) -> DataFrame:
    """(s1_id, target_id, shared): at least `least` shared tokens; inputs have (id, tokens)."""
    a = s1.where(F.size("tokens") >= least).select(F.col("id").alias("s1_id"), F.explode("tokens").alias("token"))
    b = targets.select(F.col("id").alias("target_id"), F.explode("tokens").alias("token"))
    hits = a.join(b, "token").groupBy("s1_id", "target_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if cap is None:
        return hits
    order = Window.partitionBy("s1_id").orderBy(F.desc("shared"), "target_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")


def hard_negatives(scored: DataFrame, truth: DataFrame, entities: DataFrame, top_k: int = 20, least: float = 0.10, band: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    """(s1_id, target_id) of mined negatives: those in the band first, then others, by target id within each, up to a budget.

    Budget: 4 for an entity without matches, else min(top_k - found positives, max(3, round(3.5 * matches))).
    """
    size = truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    marked = scored.where(F.col("score") >= least).join(truth.select("s1_id", "target_id", F.lit(1).alias("hit")), ["s1_id", "target_id"], "left")
    positives = marked.groupBy("s1_id").agg(F.count("hit").alias("n_pos"))
    budget = entities.select("s1_id").join(size, "s1_id", "left").join(positives, "s1_id", "left").select(
        "s1_id",
        F.when(F.col("n_true").isNull(), 4).otherwise(F.greatest(F.lit(0), F.least(top_k - F.coalesce("n_pos", F.lit(0)), F.greatest(F.lit(3), F.bround(3.5 * F.col("n_true")))))).cast("int").alias("budget"),
    )
    hard = F.col("score").between(*band)
    order = Window.partitionBy("s1_id").orderBy(F.when(hard, 0).otherwise(1), "target_id")
    return marked.where("hit is null").withColumn("place", F.row_number().over(order)).join(budget, "s1_id").where("place <= budget").select("s1_id", "target_id")


def recall_report(cands: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: true pairs, captured pairs, recall in %, candidates per entity, entities without truth, without candidates."""
    c = cands.select("s1_id", "target_id").distinct()
    got = truth.join(c.withColumn("seen", F.lit(1)), ["s1_id", "target_id"], "left").agg(F.count("*").alias("n_true"), F.count("seen").alias("captured"))
    per = entities.select("s1_id").join(c.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").join(truth.select("s1_id").distinct().withColumn("t", F.lit(1)), "s1_id", "left")
    rest = per.agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("avg_candidates"), F.count_if(F.col("t").isNull()).alias("singletons"), F.count_if(F.col("n").isNull()).alias("without"))
    return got.crossJoin(rest).withColumn("recall", F.when(F.col("n_true") == 0, 100.0).otherwise(F.round(100 * F.col("captured") / F.col("n_true"), 6)))
