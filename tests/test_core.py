"""Files, resuming, models, the end-to-end run, and constants against literal results."""

import re

import pytest
from pyspark.sql import functions as F

import tessera
from tessera.__main__ import main, parser
from tessera.functions import fuzzy
from tessera.functions import text as T
from tessera.operators import decide, evaluate, features, model, retrieval, sampling, validate
from tessera.plans import link as plans
from tessera.sources import linkage
from tessera.sources.scratch import Scratch, replace, shared_dir
from tessera.streaming import scoring


def texts(spark, f, given):
    df = spark.createDataFrame(list(enumerate(given)), "i int, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


# Text against literal results


def test_full_decomposition(spark):
    said = {"oﬁce ½": "ofice 1 2", "Ⅳ ㎏ ⑴": "iv kg 1", "ＡＢ＆Ｃ": "ab and c", "ǆ": "dz", "naïve Straße": "naive stra e", "áb": "ab", "क a": "a", "İstanbul": "istanbul", "①②": "12", "™": "tm", "ŉ": "n", "x²": "x2"}
    assert texts(spark, T.normalize_text, list(said)) == list(said.values())


def test_full_decomposition_equals_python(spark):
    import unicodedata

    given = [f"a{chr(i)}b{chr(i)}" for i in range(0x80, 0x3400) if chr(i).isprintable()]

    def plain(t):
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace("&", " and ")
        return " ".join(re.sub(r"[^a-z0-9\s]", " ", bare).split())

    got = texts(spark, T.normalize_text, given)
    assert [(g, x) for g, x in zip(given, got, strict=True) if x != plain(g)] == []


def test_legal_forms(spark):
    forms = "private limited|pvt ltd|incorporated|corporation|enterprises|associates|industries|solutions|services|limited|company|pvt|ltd|inc|corp|l l c|llc|l l p|llp|pllc|s a r l|sarl|s a s u|sasu|e u r l|eurl|s a s|sas|gmbh|s a|sa|sci|snc|gie|c o|co"
    given = forms.split("|")
    assert texts(spark, T.strip_legal_forms, [f"acme {x} north" for x in given]) == ["acme north"] * len(given)
    assert texts(spark, T.strip_legal_forms, ["cofound inca p l l c", "coco"]) == ["cofound inca p", "coco"]


def test_contractions(spark):
    said = {
        "1 rd": "1 road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bvd": "boulevard", "bd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pkwy": "parkway", "pkg": "parking",
        "hwy": "highway", "rte": "route", "r": "rue", "opp": "opposite", "b/h": "behind", "nr": "near", "apt": "apartment", "flt": "flat", "ste": "suite", "bldg": "building", "fl": "floor", "h.no 1": "house number 1",
        "hno": "house number", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "stone": "stone", "FL 33": "floor 33",
    }
    assert texts(spark, T.clean_address, list(said)) == list(said.values())


def test_states_and_tokens(spark):
    names = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
    assert texts(spark, T.state_token, [f"1 main st {x.lower()} 1" for x in names]) == names and len(names) == 50
    assert texts(spark, T.state_token, ["x dc y", "rue de la paix", ""]) == ["", "DE", ""]
    stop = "the a an of and or for in at to by le la les de du des pvt ltd llc inc corp co"
    assert texts(spark, lambda c: F.array_join(T.name_tokens(c), " "), [f"{stop} ab abc Kühn GmbH"]) == ["abc kuhn"]
    assert texts(spark, lambda c: F.array_join(T.house_tokens(c), " "), ["12/4, 7-9 x 5a 12/4"]) == ["12/4 7-9"]
    codes = texts(spark, lambda c: F.array_join(F.array_sort(T.pin_premise_tokens(c)), " "), ["Flat No. 12-B, 400001"])[0].split()
    assert set(codes) == {"12-b", "12", "400001"}
    said = {"https://www2.shop.brand-x.co.in/a?b": "brand-x", "brand.io": "brand", "a.b.edu": "b", "x.museum": "", "HTTP://WWW.Acme.US": "acme"}
    assert texts(spark, T.domain_stem, list(said)) == list(said.values())


def test_missing_columns_and_blanks(spark):
    df = spark.createDataFrame([("Acme.com Ltd", "x")], "business_name string, other string")
    row = T.normalize_records(df).first()
    assert (row.clean_name, row.clean_addr, row.is_addr_missing, row.domain_stem, row.norm_joint, row.other) == ("acme com", "", 1, "acme", "acme com acme com", "x")
    none = spark.createDataFrame([(None, "see brand.fr")], "business_name string, business_address string")
    assert T.preprocess(none).first().domain_stem == "brand"


# Kernels


def test_kernels_equal_plain_versions():
    import random

    rng = random.Random(1)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == common(a, b)
    said = {("martha", "marhta"): 0.9611, ("dixon", "dicksonx"): 0.8133, ("dwayne", "duane"): 0.84, ("abc", "xyz"): 0.0, ("", "a"): 0.0, ("a", "a"): 1.0}
    assert all(fuzzy.jaro_winkler(*k) == pytest.approx(v, abs=1e-4) for k, v in said.items())


def test_similarities_by_name(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("a b", "b a")], "a string, b string")
    rows = df.select(fuzzy.similarities(F.col("a"), F.col("b"), "sort", "jw").alias("s")).select("s.*").collect()
    assert rows[0].asDict().keys() == {"sort", "jw"} and [r["sort"] for r in rows] == [1.0, 0.0, 1.0]


# Retrieval


@pytest.mark.parametrize("k", [1, 3, 20])
def test_pruned_retrieval_equals_all_pairs(spark, k):
    import random

    rng = random.Random(k)
    words = [f"w{i}" for i in range(120)]
    rows = [("us" if i % 3 else "fr", f"t{i:03d}", " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(120)], k=rng.randint(1, 9)))) for i in range(300)]
    t = spark.createDataFrame(rows, "country string, id string, x string")
    q = spark.createDataFrame([(c, f"q{i}", x) for c, i, x in rows[:60]], "country string, id string, x string")
    vocabulary, weights = retrieval.weigh(t, retrieval.word_terms(F.col("x")), max_df=1.0)
    asked = retrieval.weigh_queries(q, retrieval.word_terms(F.col("x")), vocabulary)
    rows_of = lambda df: sorted((r.s1_id, r["rank"], r.target_id, round(r.score, 5)) for r in df.select("s1_id", "rank", "target_id", "score").collect())
    every = {(r[0], r[2]): r[3] for r in rows_of(retrieval.top(retrieval.cosine(asked, weights), 10**6))}
    plain, pruned = rows_of(retrieval.coarse(asked, weights, k)), rows_of(retrieval.coarse(asked, weights, k, direct=0))
    # Sums differ in their last digits by the order of their parts, so ties may change places; scores may not.
    assert [(a[0], a[1]) for a in plain] == [(b[0], b[1]) for b in pruned]
    assert all(abs(a[3] - b[3]) <= 2e-5 and abs(every[b[0], b[2]] - b[3]) <= 2e-5 for a, b in zip(plain, pruned, strict=True))


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_by_blocks_equals_all_pairs(spark, monkeypatch, k):
    """On odd records: repeated ids, null and empty texts, long words, countries that only one side has; in pieces of a few rows."""
    import random

    import numpy as np

    from tessera.operators import nearest as N

    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)] + ["x", "é", "ñandú", "q" * 70, "straße"]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 9)))
    rows = [("us" if i % 3 else "fr", f"t{i % 140:03d}", text()) for i in range(150)] + [("us", "t900", None), ("us", "t901", ""), ("fr", "t902", "  "), ("de", "t903", "w1 w2"), (None, "t904", "w1")]
    asked = [("us" if i % 3 else "fr", f"q{i % 44}" if i % 3 else f"f{i}", text()) for i in range(50)] + [("us", "q900", None), ("us", "q901", " x "), ("es", "q902", "w1 w2")]
    t, q = (spark.createDataFrame(x, "country string, id string, x string") for x in (rows, asked))
    terms = {"words": retrieval.word_terms, "chars": retrieval.char_terms}
    got = lambda df: {(r.s1_id, r["rank"]): (r.target_id, r.score) for r in df.collect()}
    for kind, of in terms.items():
        x = of(F.col("x"))
        vocabulary, weights = retrieval.weigh(t, x, max_df=0.5)
        known = {tuple(r)[:2]: r.idf for r in vocabulary.collect()}
        assert {tuple(r)[:2]: r.idf for r in retrieval.vocabulary(t, of, max_df=0.5).collect()} == pytest.approx(known)
        every = {(r.s1_id, r.target_id): r.score for r in retrieval.cosine(retrieval.weigh_queries(q, x, vocabulary), weights).collect()}
        plain = got(retrieval.top(retrieval.cosine(retrieval.weigh_queries(q, x, vocabulary), weights), k))
        found = got(N.nearest(q, t, [N.Stage(kind, vocabulary)], k))
        assert plain.keys() == found.keys() and len(plain) > 20
        assert all(abs(plain[p][1] - found[p][1]) <= 2e-6 and abs(every[p[0], found[p][0]] - found[p][1]) <= 2e-6 for p in plain)
    # The same in small pieces and steps, on one block.
    monkeypatch.setattr(N, "PIECE", 7)
    monkeypatch.setattr(N, "STEP", 40)
    block = {"part": [], "s1_id": [], "target_id": [], "x": [], "term": [], "idf": []}
    put = lambda *row: [block[n].append(v) for n, v in zip(block, row, strict=True)]
    for part, of in enumerate(terms.values()):
        for r in retrieval.vocabulary(t, of, max_df=0.5).where("country = 'us'").collect():
            put(part, None, None, None, r.term, r.idf)
    for part, df in ((-2, q), (-1, t)):
        for r in N.merge(df).where("country = 'us'").collect():
            put(part, *((r.id, None) if part == -2 else (None, r.id)), r.x, None, None)
    table = N.pa.table({n: N.pa.array(v, N.pa.list_(N.pa.string()) if n == "x" else None) for n, v in block.items()})
    small = [(a.as_py(), b.as_py(), s, int(r)) for x, y, u, v in N._block(table, list(terms), k, None, None) for a, b, s, r in zip(x, y, u, v, strict=True)]
    whole = retrieval.rescored(q.where("country = 'us'"), t, k, 0.5, 0.5).collect()
    assert sorted((r.s1_id, r.target_id, r.score, r["rank"]) for r in whole) == sorted(small) and np.isfinite([r[2] for r in small]).all()


def shuffled(spark, df) -> int:
    """Bytes that the stages of one run write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(x.shuffleWriteBytes() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = written()
    df().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written() - before


def test_search_leaves_nothing_in_its_worker(monkeypatch):
    """When a block's last result is out, its texts and vocabulary are gone and what they took goes back to the system."""
    from tessera.operators import nearest as N

    pa, left = N.pa, []
    start = pa.total_allocated_bytes()
    monkeypatch.setattr(N, "_let_go", lambda: left.append(pa.total_allocated_bytes() - start))

    def batches():
        words = [f"word{i}" for i in range(2000)]
        rows = [(-2, "q", None, [" ".join(words)], None, None), *((-1, None, f"t{i:04d}", [f"{w} {w}x"], None, None) for i, w in enumerate(words)), *((0, None, None, None, w, 1.0) for w in words)]
        kinds = {"part": pa.int32(), "s1_id": pa.string(), "target_id": pa.string(), "x": pa.list_(pa.string()), "term": pa.string(), "idf": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    found = N._results(batches(), ["words"], 300, None, None)
    assert sum(x.num_rows for x in found) == 300 and len(left) == 1 and left[0] < 10_000


def test_search_shuffles_texts_not_pairs(spark):
    """600 records a side with 300 candidates each: their pairs of postings are many times the texts."""
    import random

    rng = random.Random(5)
    words = [f"{a}{b}ston" for a in "bcdfghklmn" for b in "aeiou"]
    make = lambda p: spark.createDataFrame([("us", f"{p}{i}", " ".join(rng.choices(words, k=12))) for i in range(600)], "country string, id string, x string")
    q, t = make("q"), make("t")
    assert 0 < shuffled(spark, lambda: retrieval.candidates(q, t, word_max_df=1.0, char_max_df=1.0)) < 4e6


def test_id_of_two_countries(spark):
    """Its candidates come from both, as one list."""
    q = spark.createDataFrame([("us", "S1-1", "alpha beta"), ("fr", "S1-1", "gamma delta"), ("fr", "S1-2", "gamma")], "country string, id string, x string")
    t = spark.createDataFrame([("us", "S2-1", "alpha beta"), ("fr", "S2-2", "gamma"), ("fr", "S2-3", "gamma omega")], "country string, id string, x string")
    found = retrieval.candidates(q, t, word_max_df=1.0, char_max_df=1.0).collect()
    assert sorted((r.s1_id, r.target_id, r["rank"]) for r in found) == [("S1-1", "S2-1", 1), ("S1-1", "S2-2", 2), ("S1-1", "S2-3", 3), ("S1-2", "S2-2", 1), ("S1-2", "S2-3", 2)]


def test_two_stages_against_exact(spark):
    q = spark.createDataFrame([("us", "S1-1", "alpha beta gamma"), ("us", "S1-2", "zzz")], "country string, id string, x string")
    t = spark.createDataFrame([("us", "S2-1", "alpha beta gamma"), ("us", "S2-2", "alphas betas"), ("us", "S2-3", "gamma beta")], "country string, id string, x string")
    exact = retrieval.exact_candidates(q, t, char_max_df=1.0)
    row = retrieval.compare(retrieval.candidates(q, t, word_max_df=1.0, char_max_df=1.0), exact, q.select(F.col("id").alias("s1_id"))).first()
    assert row.queries == 2 and 50 < row.recall < 100 and row.same == 50.0
    assert retrieval.compare(exact, exact, q.select(F.col("id").alias("s1_id"))).first().recall == 100.0


# Files


def test_output_is_replaced_whole(spark, tmp_path):
    at = str(tmp_path / "out")
    lists = lambda *rows: spark.createDataFrame(list(rows), "s1_id string, ids string")
    linkage.write_lists(lists(("a", "x")), at, linkage.MATCHES)
    linkage.write_lists(lists(("a", "y"), ("b", "")), at, linkage.MATCHES)
    read = lambda p: {r.s1_id: r.ids for r in linkage.read_lists(spark, p, linkage.MATCHES).collect()}
    assert read(at) == {"a": ["y"], "b": []} and read(f"{at}.bak") == {"a": ["x"]} and not (tmp_path / "out.tmp").exists()
    broken = lists(("c", "z")).withColumn("ids", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        linkage.write_lists(broken, at, linkage.MATCHES)
    assert read(at) == {"a": ["y"], "b": []}
    with pytest.raises(FileNotFoundError):
        replace(spark, str(tmp_path / "none"), at)


def test_a_stopped_run_goes_on(spark, tmp_path):
    at, seen = str(tmp_path / "out"), []
    entities = spark.createDataFrame([(f"S1-{i}",) for i in range(40)], "s1_id string")

    def decided(ids):
        seen.append(ids.count())
        if len(seen) == 3:
            raise InterruptedError
        return ids.withColumn("ids", F.lit("S2-1"))

    with pytest.raises(InterruptedError):
        linkage.run_in_buckets(entities, decided, at, linkage.MATCHES, buckets=5)
    assert not (tmp_path / "out").exists()
    assert linkage.run_in_buckets(entities, decided, at, linkage.MATCHES, buckets=5) == 3
    assert linkage.read_lists(spark, at, linkage.MATCHES).count() == 40 and not (tmp_path / "out.parts").exists()
    with pytest.raises(ValueError, match="stays"):
        linkage.run_in_buckets(entities, lambda ids: ids.limit(1).withColumn("ids", F.lit("")), at, linkage.MATCHES, buckets=2)
    assert linkage.read_lists(spark, at, linkage.MATCHES).count() == 40


def test_reads_of_lines_ids_and_blanks(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tx\t\tUS\n\nS1-2\t\ty\t\n")
    at = str(tmp_path / "a.tsv")
    assert sorted(r.id for r in linkage.read_ids(spark, at).collect()) == ["S1-1", "S1-2"]
    assert [r.business_address for r in linkage.read_records(spark, at, blank_as_null=True).orderBy("entity_id").collect()] == [None, "y"]
    assert [r.business_name for r in linkage.read_records(spark, at).orderBy("entity_id").collect()] == ["x", ""]
    assert linkage.first_existing(spark, None, str(tmp_path / "no"), at) == at and linkage.first_existing(spark, str(tmp_path / "no")) is None
    made = spark.createDataFrame([("a", "b", 1)], "s1_id string, target_id string, rank int")
    assert linkage.candidates_or(spark, lambda: made, str(tmp_path / "no")).count() == 1
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2,S2-1\n")
    assert [(r.target_id, r["rank"]) for r in linkage.candidates_or(spark, lambda: made, None, str(tmp_path / "c.tsv")).collect()] == [("S2-2", 1), ("S2-1", 2)]


def test_check_of_files(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")

    def write(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    head = "source1_entity_id\tmatched_entity_ids\n"
    good = write("good", head + "S1-1\tS2-1,S3-1\nS1-2\t\n")
    found = validate.check(spark, good, ids("S1-1", "S1-2"), str(tmp_path / "no"))
    assert found.status == 0 and found.rows == {good: (2, 1)} and len(found.warnings) == 1
    cands = write("cands", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\tS2-9\n")
    found = validate.check(spark, good, ids("S1-1", "S1-2"), cands, ids("S2-1", "S3-1"))
    assert [w for w in found.warnings if "no candidates" in w] and [e for e in found.errors if "unknown_id: 1" in e] and found.status == 1
    bad = write("bad", head + "S1-1\tS2-1,S2-1\nS1-1\tS1-9\nno tab here\n \nS1-7\tQ\n")
    said = " ".join(validate.check(spark, bad, ids("S1-1", "S1-2")).errors)
    assert all(f"{rule}: 1" in said for rule in ("duplicate_row", "duplicate_id", "self_match", "bad_prefix", "missing_row", "extra_row", "no_tab"))
    for body, why in (("", "empty"), ("source1_entity_id,matched_entity_ids\nS1-1,x\n", "commas"), ("a\tb\n", "header")):
        assert why in validate.check(spark, write("odd", body), ids("S1-1")).errors[0]
    assert "missing" in validate.check(spark, str(tmp_path / "no"), ids("S1-1")).errors[0]
    assert validate.check(spark, write("case", head.upper() + "S1-1\t\n"), ids("S1-1")).status == 0


def test_scratch_tables_go(spark):
    import os

    scratch = Scratch(spark, "t")
    a, b = (scratch.save(spark.range(3), x) for x in "ab")
    scratch.keep_only(b)
    folder = scratch.root.removeprefix("file://")
    assert len(os.listdir(folder)) == 1 and b.count() == 3 and scratch.root.startswith(shared_dir(spark))


# Models, samples, end to end


PAIRS = "s1_id string, target_id string, rank int, f double, g double"


def pairs(spark):
    rows = [(f"S1-{i}", f"S2-{j}", j + 1, 1.0 - 0.2 * j + i % 3 / 100, i % 5 / 5) for i in range(60) for j in range(4)]
    return spark.createDataFrame(rows, PAIRS), spark.createDataFrame([(f"S1-{i}", "S2-0") for i in range(60)], "s1_id string, target_id string")


def test_models_are_kept_and_challenged(spark, tmp_path):
    df, truth = pairs(spark)
    marked, names, at, fits = model.split(model.label(df, truth)), ["f", "g"], str(tmp_path / "model"), []

    def fit():
        fits.append(1)
        return model.train(marked, names, rounds=3, depth=2, positive_weight=None), {"link": 0.5}

    first = model.train_or_load(spark, at, names, fit)
    assert model.train_or_load(spark, at, names, fit)[1] == first[1] == {"link": 0.5} and len(fits) == 1
    model.train_or_load(spark, at, names, fit, force=True)
    assert len(fits) == 2 and (tmp_path / "model.bak").exists()
    for p in (tmp_path / "model" / "model").rglob("*"):
        if p.is_file():
            p.write_bytes(b"")
    model.train_or_load(spark, at, names, fit)
    assert len(fits) == 3
    # The higher score takes the place; a tie does not.
    better = model.challenge(spark, at, first[0], {"link": 0.5}, names, lambda m, t: float(m is first[0]))
    assert better == ("challenger", 0.0, 1.0)
    tie = model.challenge(spark, at, first[0], {"link": 0.5}, names, lambda m, t: 0.5)
    assert tie[0] == "champion" and (tmp_path / "model.challenger").exists()
    assert model.importance(first[0], names)[0][0] == "f"
    assert {k: (p["rounds"], p["rate"], p["depth"], p["positive_weight"]) for k, p in model.PRESETS.items()} == {"xgboost": (800, 0.04, 6, 0.6), "catboost": (1000, 0.04, 6, 0.6), "conflict": (600, 0.06, 6, 0.7), "retrained": (1000, 0.05, 7, None)}


def records(tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    names = [f"{a} {b} {c}" for a in ("amber", "birch", "cedar", "delta", "ember", "fjord") for b in ("mills", "works", "foods", "glass") for c in ("house", "group")]
    rows = {1: [], 2: [], 3: []}
    truth = []
    for i, n in enumerate(names):
        country = "US" if i % 3 else "France"
        rows[1].append(f"S1-{i}\t{n} Ltd\t{i} Main St\t{country}")
        rows[2].append(f"S2-{i}\t{n.upper()} Inc\t{i} main street\t{country}")
        rows[3].append(f"S3-{i}\t{n.split()[0]} {n.split()[1]} other\t\t{country}")
        truth.append(f"S1-{i}\tS2-{i}" if i % 4 else f"S1-{i}\t")
    for k, lines in rows.items():
        (tmp_path / f"s{k}.tsv").write_text(head + "\n".join(lines) + "\n")
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "\n".join(truth) + "\n")
    return [str(tmp_path / f"s{k}.tsv") for k in (1, 2, 3)], str(tmp_path / "truth.tsv")


def test_end_to_end(spark, tmp_path):
    files, truth = records(tmp_path)
    folder = str(tmp_path / "sample")
    counts = plans.sample(spark, *files, truth, folder, {"US": 30, "France": 12}, distractors=20)
    assert counts["s1"] == counts["truth"] == 42 and counts["singletons"] > 0 and counts["candidate_pairs"] > 42
    assert linkage.read_records(spark, f"{folder}/sample_source1.tsv").count() == 42
    out = [str(tmp_path / x) for x in ("matches.tsv", "candidates.tsv", "model")]
    found, scores = plans.link(spark, *files, *out, truth=truth, sample=folder, preset={"rounds": 5, "depth": 3}, buckets=2)
    assert found.status == 0 and found.rows[out[0]][0] == found.rows[out[1]][0] == 48 and not found.warnings
    assert scores.first().macro_f05 > 0.5
    found, _ = plans.link(spark, *files, *out, country="france", limit=5, buckets=2)
    assert found.rows[out[0]][0] == 5
    with pytest.raises(ValueError, match="country"):
        plans.link(spark, *files, *out, country="spain")
    assert main(["check", "--matches", out[0], "--candidates", out[1], "--s1", files[0]]) == 1  # 43 rows are missing now
    assert parser().parse_args(["link", *[x for n in ("s1", "s2", "s3", "matches", "candidates", "model") for x in (f"--{n}", "x")]]).top_k == 20


def test_bundle(tmp_path):
    import zipfile

    for name in ("a.tsv", "code/x.py", "code/sub/y.py", "code/__pycache__/x.cpython.pyc", "code/.git/z", "code/z.pyc", "code/.hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    out = str(tmp_path / "out.zip")
    assert main(["bundle", "--out", out, "--files", str(tmp_path / "a.tsv"), "--code", str(tmp_path / "code")]) == 0
    assert sorted(zipfile.ZipFile(out).namelist()) == ["a.tsv", "code/sub/y.py", "code/x.py"]
    with pytest.raises(FileNotFoundError, match="none"):
        tessera.bundle(out, [str(tmp_path / "none.tsv")], str(tmp_path / "code"))


def test_names_of_the_package():
    assert all(hasattr(tessera, n) for n in tessera.__all__)


# Decisions, grids, streams


def test_blend_of_loaded_models(spark):
    df = spark.createDataFrame([(0.8, 0.2)], "a double, b double")
    got = df.select(decide.blend_loaded({"catboost": "a", "lightgbm": "b"}).alias("x"), decide.blend_loaded({"m": "a", "n": "b"}, {"m": 3.0, "n": 1.0}).alias("y"), decide.blend_loaded({"new": "a"}).alias("z")).first()
    assert got.x == pytest.approx((0.4 * 0.8 + 0.25 * 0.2) / 0.65) and got.y == pytest.approx(0.65) and got.z == pytest.approx(0.8)
    with pytest.raises(ValueError):
        decide.blend_loaded({})


def test_band(spark):
    e = spark.createDataFrame([(f"{i}",) for i in range(10)], "s1_id string")
    band = lambda n: evaluate.match_band(spark.range(n), e).first().band
    assert [band(n) for n in (19, 20, 45, 46)] == ["low", "ok", "ok", "high"]


def test_grid_with_a_quota_agrees_with_single_rules(spark):
    rows = [("a", f"t{i}", i + 1, p, m) for i, (p, m) in enumerate([(0.95, 1), (0.9, 1), (0.9, 0), (0.6, 1), (0.5, 0)])] + [("b", "t9", 1, 0.4, 1)]
    scored = spark.createDataFrame(rows, "s1_id string, target_id string, rank int, prob double, is_missing int")
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    true = spark.createDataFrame([("a", "t0"), ("a", "t2"), ("b", "t9")], "s1_id string, target_id string")
    for r in evaluate.grid(scored, true, e, [0.3, 0.7], [0.2, 0.5], [0.0, 0.6], [1, 9], missing_quota=1).collect():
        kept = decide.kept(scored, link=r.link, singleton=r.singleton, margin=r.margin, cap=r.cap, missing_quota=1)
        assert evaluate.macro(kept, true, e).first().macro_f05 == r.macro_f05


def test_a_stream_may_split_an_entity(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("a", "t1", 1, 0.9), ("b", "t1", 1, 0.1)], [("a", "t2", 2, 0.8), ("c", "t3", 1, 0.7)], [("b", "t4", 2, 0.9)]]
    seen = {}

    def sink(df, number):
        seen.update({r.s1_id: r.matches for r in df.collect()})

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, scoring.PAIR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(scoring.PAIR).parquet(str(tmp_path / "in"))
        query = scoring.decide_stream(stream, sink, str(tmp_path / "state"), link=0.5, singleton=0.3)
        assert query.awaitTermination(60)
    rows = spark.createDataFrame([r for b in batches for r in b], scoring.PAIR)
    whole = decide.decide(rows, rows.select("s1_id").distinct(), link=0.5, singleton=0.3)
    assert seen == {r.s1_id: r.matches for r in whole.collect()}


def test_batch_features(spark):
    kind = "entity_id string, business_name string, business_address string, country string"
    a = spark.createDataFrame([("S1-1", "Acme Ltd brand", "12 x st", "US")], kind)
    t = spark.createDataFrame([("S2-1", "Acme other co", "", "US")], kind)
    c = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-404", 2)], "s1_id string, target_id string, rank int")
    get = lambda v: features.pair_features(c, a, t, v).collect()
    batch, tolerant = get("v18_batch"), get("v18_tolerant")
    assert len(batch) == 1 and batch[0].len_diff_addr == 1.0 and batch[0].addr_jaro_winkler == 0.0
    assert batch[0].extra_words == tolerant[0].extra_words == pytest.approx(2 / 3)
    assert features.known_pairs(c, a, t).collect()[0]["rank"] == 1


def test_samples_without_a_seed(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("b", 2)], "s string, k int")
    assert sorted(r.k for r in sampling.first_by_key(df, ["s"], "k").collect()) == [1, 2]
    assert sorted(r.k for r in sampling.with_distractors(df, df.where("k = 3"), 1, key="k", seed=None).collect()) == [1, 3]
