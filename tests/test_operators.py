import pytest
from pyspark.sql import functions as F

from tessera.operators import decide, evaluate, features, retrieval, sampling, validate
from tessera.sources import linkage


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "s1_id string")


def test_lists_round_trip(spark, tmp_path):
    e = ids(spark, "S1-1", "S1-2")
    pairs = spark.createDataFrame([("S1-1", "S2-9", 2), ("S1-1", "S3-4", 1)], "s1_id string, target_id string, rank int")
    linkage.write_lists(linkage.to_lists(pairs, e), str(tmp_path / "out"), "matched_entity_ids")
    back = linkage.read_lists(spark, str(tmp_path / "out"), "matched_entity_ids")
    assert {r.s1_id: r.ids for r in back.collect()} == {"S1-1": ["S3-4", "S2-9"], "S1-2": []}
    assert linkage.edges(back).count() == 2


def test_records_keep_quotes_and_blanks(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b"""\t\tUS\nS1-2\tNA\tx\tFR\n')
    rows = linkage.read_records(spark, str(tmp_path / "s.tsv")).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'a "b"', "", "US"), ("S1-2", "NA", "x", "FR")]


def test_candidates_find_the_same_name(spark):
    q = spark.createDataFrame([("us", "S1-1", "alpha beta gamma"), ("us", "S1-2", "zzz")], "country string, id string, x string")
    t = spark.createDataFrame([("us", "S2-1", "alpha beta gamma"), ("us", "S2-2", "alpha delta"), ("us", "S2-3", "gamma beta"), ("fr", "S2-4", "alpha beta gamma")], "country string, id string, x string")
    found = retrieval.candidates(q, t, word_max_df=1.0, char_max_df=1.0).collect()
    assert {r.target_id for r in found if r["rank"] == 1} == {"S2-1"}
    assert not [r for r in found if r.target_id == "S2-4" or r.s1_id == "S1-2"]


def scored(spark):
    rows = [("S1-1", "S2-1", 1, 0.9, 0, 1.0), ("S1-1", "S2-2", 2, 0.8, 1, 0.5), ("S1-1", "S2-3", 3, 0.8, 1, 0.95), ("S1-1", "S2-4", 4, 0.2, 0, 1.0), ("S1-2", "S2-1", 1, 0.1, 0, 1.0)]
    return spark.createDataFrame(rows, "s1_id string, target_id string, rank int, prob double, is_missing int, name_sim double")


def test_decide(spark):
    e = ids(spark, "S1-1", "S1-2", "S1-3")
    got = lambda **k: {r.s1_id: r.matches for r in decide.decide(scored(spark), e, **k).collect()}
    assert got(link=0.5, singleton=0.3) == {"S1-1": "S2-1,S2-2,S2-3", "S1-2": "", "S1-3": ""}
    assert got(link=0.5, singleton=0.3, cap=2)["S1-1"] == "S2-1,S2-2"
    # a row rejected for its name does not use the quota up
    assert got(link=0.5, singleton=0.3, missing_quota=1, missing_least=0.9)["S1-1"] == "S2-1,S2-3"
    assert got(link=0.1, singleton=0.95)["S1-1"] == ""


def test_metric_conventions(spark):
    e = ids(spark, "a", "b", "c", "d")
    pred = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")], "s1_id string, target_id string")
    true = spark.createDataFrame([("a", "x"), ("a", "y"), ("d", "x")], "s1_id string, target_id string")
    row = evaluate.macro(pred, true, e).first()
    assert row.macro_f05 == pytest.approx((0.714286 + 0 + 1 + 0) / 4, abs=1e-5)
    assert row.macro_recall == pytest.approx((1 + 1 + 1 + 0) / 4, abs=1e-5)
    assert evaluate.macro(pred, true, e, lenient=False).first().macro_recall == pytest.approx(0.5, abs=1e-5)


def test_grid_agrees_with_single_rules(spark):
    e, true = ids(spark, "S1-1", "S1-2", "S1-3"), spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    for r in evaluate.grid(scored(spark), true, e, [0.5, 0.85], [0.05, 0.3], [0.0, 0.95], [1, 3]).collect():
        kept = decide.kept(scored(spark), link=r.link, singleton=r.singleton, margin=r.margin, cap=r.cap)
        assert evaluate.macro(kept, true, e).first().macro_f05 == r.macro_f05


def test_validation(spark):
    rows = [("S1-1", ["S2-1", "S2-1"]), ("S1-1", ["S1-2"]), ("S1-9", ["Q"])]
    found = validate.errors(spark.createDataFrame(rows, "s1_id string, ids array<string>"), spark.createDataFrame([("S1-1",), ("S1-2",)], "id string"))
    assert {(r.rule, r.s1_id) for r in found.collect()} == {("duplicate_row", "S1-1"), ("duplicate_id", "S1-1"), ("self_match", "S1-1"), ("bad_prefix", "S1-9"), ("missing_row", "S1-2"), ("extra_row", "S1-9")}
    lines = spark.createDataFrame([("a\tb",), ("a,b",), (" ",)], "value string")
    assert validate.bad_lines(lines).count() == 1


def test_pair_rules(spark):
    df = spark.createDataFrame([(12, 1234, ["a", "the"], ["a", "b"])], "p int, q int, a array<string>, b array<string>")
    r = df.select(features.door_conflict(F.col("p"), F.col("q")).alias("d"), features.extra_words(F.col("a"), F.col("b")).alias("x"), features.extra_words(F.col("a"), F.col("b"), True).alias("y")).first()
    assert (r.d, r.x, r.y) == (0.0, 1.0, 0.0)


def test_sampling(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 100)], "s string, k int")
    assert sampling.stratified(df, "s", "k", 3, seed=None).count() == 4
    assert sampling.with_distractors(df, df.where("k = 100"), 2, key="k").count() == 3


def test_boosted_trees_train_in_full(spark, monkeypatch):
    from inspect import signature

    from tessera.plans import catalogue

    bound, seen = signature(catalogue.model.train), {}

    def train(*args, **rule):
        found = bound.bind(*args, **rule)
        found.apply_defaults()
        seen.update(found.arguments)
        raise InterruptedError

    monkeypatch.setattr(catalogue.model, "train", train)
    with pytest.raises(InterruptedError):
        catalogue.QUERIES["boosted_trees"](spark, "/root/testdata/sf0.001")
    assert (seen["rounds"], seen["depth"]) == (40, 6)
