"""The thin opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, langid, media, secrets, sharding, suffix_dedup, token_codec, toxicity
from tessera.llm.common import Scratch, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.default_path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "op3").path("segments")
    token_codec.write_table(table(spark, sf_dir, "documents"), at, bpe.default_path("byte_bpe_50k.json"), end_id=2)
    return token_codec.read_table(spark.read.parquet(at))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.is_held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"), Scratch(spark, "op5")).with_bodies().drop("digest")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.is_held_out())
    scorer = toxicity.fit(docs, labels, Scratch(spark, "op7"))
    scored = toxicity.predict(docs, scorer)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), texts=False)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op9"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), words=3, percent=90)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_token_files, op4_language, op5_media, op6_secrets, op7_toxicity, op8_suffix_dedup, op9_decontamination, op10_jaccard)}
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS9 = rf"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op9_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS9} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, w[i + 1 : i + 10] AS k, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
every AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
hits AS (SELECT doc_id, i, win.n, item_id FROM every JOIN (SELECT DISTINCT n FROM win) s ON i + s.n <= len(w)
         JOIN win ON win.n = s.n AND array_to_string(win.k, ' ') = array_to_string(w[i + 1 : i + s.n], ' ')),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
one AS (SELECT k, n, row_number() OVER () AS wid FROM (SELECT DISTINCT k, n FROM win)),
pos AS (SELECT doc_id, i, w[i + 1] AS t FROM every WHERE w[i + 1] IN (SELECT unnest(k) FROM one)),
term AS (SELECT wid, n, off, t, coalesce(c, 0) AS c, min(coalesce(c, 0)) OVER (PARTITION BY wid) AS least FROM (SELECT wid, n, off, k[off + 1] AS t FROM (SELECT *, unnest(range(0, n)) AS off FROM one))
         LEFT JOIN (SELECT t, count(*) AS c FROM pos GROUP BY t) USING (t)),
rare AS (SELECT wid, n, off, t FROM term WHERE least > 0 QUALIFY row_number() OVER (PARTITION BY wid ORDER BY c, off) = 1),
occ AS (SELECT wid, n, rare.off AS at, doc_id, i - off AS start FROM rare JOIN pos USING (t)),
near AS (SELECT wid, doc_id, start FROM occ WHERE n = 1 UNION ALL
         SELECT occ.wid, occ.doc_id, start FROM occ JOIN term o ON o.wid = occ.wid AND o.off <> occ.at JOIN pos p ON p.doc_id = occ.doc_id AND p.t = o.t AND p.i BETWEEN start + o.off - 3 AND start + o.off + 3
         GROUP BY occ.wid, occ.doc_id, start, occ.n HAVING count(DISTINCT o.off) = occ.n - 1),
about AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN one USING (wid) JOIN win USING (k, n) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN about USING (doc_id)""",
}
