"""Nulls, repeated and odd keys, empty tables, clashing columns, very long texts, and the registered queries themselves."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, decontam, jaccard, langid, queries, secrets, sharding, suffix_dedup, token_codec, toxicity
from tessera.llm.common import Scratch

BYTES = bpe.default_path("byte_bpe_50k.json")
KEYS = [(7, "a"), (7, "b"), (None, "a"), (None, None), (3, ""), (3, ""), (5, "long " * 20_000)]


def frame(spark, rows, kind="long"):
    """Extra columns have names that operators use inside."""
    schema = f"doc_id {kind}, text string, doc string, id string, n int, hub string, shard string, `_hot` int, spans string, word string"
    return spark.createDataFrame([(k, t, "x", "y", 1, "z", "s", 2, "p", "w") for k, t in rows], schema)


@pytest.fixture(scope="module")
def keyed():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(8)]
    return [(1, said[0]), (1, said[0]), (1, said[1]), (None, said[0]), (None, said[2]), (None, None), (2, said[2] + " tail"), (4, said[3]), (4, "short"), (6, ""), (6, said[4] + " " + said[3])]


# Token files


def library_ids(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 2]


def test_ranks_equal_the_library_on_every_character():
    lib, encode = Tokenizer.from_file(BYTES), token_codec.encoder(BYTES)
    known = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [p.format(c) for c in known for p in ("a{0}a 1{0}1 {0} {0}{0}!",)]
    texts = ["\n".join(texts[i : i + 40]) for i in range(0, len(texts), 40)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(t), "<u4").tolist() == e.ids, ascii(t[:40])


def test_ranks_equal_the_library_on_random_texts():
    lib, encode, rng = Tokenizer.from_file(BYTES), token_codec.encoder(BYTES), random.Random(1)
    vocabulary = [lib.decode([i]) for i in range(0, 50_000, 7)]
    for _ in range(3000):
        t = "".join(rng.choices(vocabulary, k=rng.randint(1, 12))) if rng.random() < 0.7 else "".join(rng.choices("ab's  \n\t\x85\xa0é1.", k=rng.randint(1, 40)))
        assert np.frombuffer(encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)
    for t in ("a" * 5000, " " * 5000 + "x", "é" * 3000, "x <|endoftext|> y", "word " * 9000):
        assert np.frombuffer(encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["long", "string"])
def test_token_files_of_odd_keys(spark, tmp_path, kind):
    rows = [(k if k is None or kind == "long" else str(k), t) for k, t in KEYS]
    lib = Tokenizer.from_file(BYTES)
    token_codec.write_table(frame(spark, rows, kind).repartition(3), str(tmp_path / "t"), BYTES, end_id=2)
    got = token_codec.read_table(spark.read.parquet(str(tmp_path / "t")), kind=kind).orderBy("start").collect()
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "") if kind == "string" else (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (k, t) in zip(got, wanted, strict=True):
        ids = library_ids(lib, t)
        assert tuple(r) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    token_codec.write_table(frame(spark, []), str(tmp_path / "t"), BYTES, end_id=2)
    assert token_codec.read_table(spark.read.parquet(str(tmp_path / "t"))).count() == 0


def test_single_blocks_and_documents():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = [rng.integers(0, h, n).astype(np.uint32) for n, h in ((0, 9), (5, 50_000), (20_000, 50_000), (0, 3), (8192, 2), (1, 1 << 31), (30_000, 70_000))]
    one = token_codec.Segment(token_codec.to_segment(pa.array([None, *"abcdef"]), ids))
    flat = np.concatenate(ids)
    assert (one.ids() == flat).all() and one.keys().to_pylist() == [None, *"abcdef"]
    for b in range(-(-len(flat) // token_codec.BLOCK)):
        assert (one.block(b) == flat[b * token_codec.BLOCK : (b + 1) * token_codec.BLOCK]).all()
    assert all((one.document(i) == x).all() and len(one.document(i)) == len(x) for i, x in enumerate(ids))


# BPE


def test_bpe_of_nothing_and_of_clashing_columns(spark):
    none = frame(spark, [])
    assert bpe.round_trip_digests(none, BYTES).count() == 0 and bpe.encode(none, BYTES).count() == 0
    with pytest.raises(ValueError, match="Shard"):
        bpe.encode(none, BYTES, out="Shard")
    got = bpe.round_trip_digests(frame(spark, KEYS), BYTES).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got)[-1] == (7, 1) and len(got) == len(KEYS)


# Decontamination and Jaccard join of odd keys


def items_of(text, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in bench:
        x = words(t)
        n = min(10, len(x))
        for s in range(len(x) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i))
    return len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_decontamination_of_repeated_and_null_keys(spark, keyed, kind):
    halves = keyed[0][1].split()
    rows = [*keyed, (9, " ".join(halves[:5]) + " q q"), (9, "q q " + " ".join(halves[5:10]))]
    rows = [(k if k is None or kind == "long" else str(k), t) for k, t in rows]
    bench = [(1, " ".join(halves[:10])), (2, rows[4][1]), (3, None), (2, rows[4][1])]
    items = spark.createDataFrame(bench, "item_id long, text string")
    df = frame(spark, rows, kind).repartition(3)
    got = decontam.report(df, items, Scratch(spark, "t")).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got))) == sorted(map(repr, ((k, *items_of(t, bench)) for k, t in rows)))
    kept = decontam.clean(df, items, Scratch(spark, "t"))
    assert kept.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, ((k, t) for k, t in rows if not items_of(t, bench)[1])))


def groups_of(texts, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            group = [group[i] if g == group[j] else g for g in group]
    return sets, group


@pytest.mark.parametrize("kind", ["long", "string"])
def test_jaccard_of_repeated_and_null_keys(spark, keyed, kind):
    rows = [(k if k is None or kind == "long" else str(k), t) for k, t in keyed]
    sets, group = groups_of([t for _, t in rows], 3, 90)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    got = jaccard.components(frame(spark, rows, kind).repartition(3), Scratch(spark, "t")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ((k, len(s), least[g]) for (k, _), s, g in zip(rows, sets, group, strict=True))))


def test_words_made_to_collide_stay_apart():
    """Thue-Morse words defeat polynomials modulo 2 ** 64 of any base."""
    t = "a"
    for _ in range(12):
        t += t.translate(str.maketrans("ab", "ba"))
    for n in (64, 128, 256, 1024, 4096):
        a, b = t[:n], t[:n].translate(str.maketrans("ab", "ba"))
        assert len({int(jaccard.word_hashes([x])[0][0]) for x in (a, b)}) == 2
    words = [w.encode() for w in ("a", "b", "ab", "abcdefgh", "abcdefghi", "x" * 300, "é" * 130)]
    hashes, counts = jaccard.word_hashes([" ".join(w.decode() for w in words), None, "", "  A b  "])
    assert counts.tolist() == [7, 0, 0, 2] and len(set(hashes[:7].tolist())) == 7 and hashes[7:].tolist() == hashes[:2].tolist()


def test_unlinked_documents_with_one_phrase(spark):
    """A phrase that all documents share brings none of them together, whatever its words."""
    rng = random.Random(0)
    texts = [" ".join([*(f"w{rng.randrange(4000)}" for _ in range(25)), "zyx", "wvu", "tsr", "qpo"]) for _ in range(3000)]
    table = jaccard._common(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    lists = list(jaccard.shingle_lists(texts, 3, table))
    first = [x for s in lists for x in s[: len(s) - jaccard.needed(len(s), 90) + 1].tolist()]
    counts = np.unique(np.array(first, np.uint64), return_counts=True)[1]
    assert counts.max() <= 10
    got = jaccard.components(frame(spark, list(enumerate(texts))), Scratch(spark, "t")).where("component_id <> doc_id")
    assert got.count() == 0


@pytest.mark.parametrize("tokens", [4_000_000, 200])
def test_jaccard_by_five_words(spark, keyed, monkeypatch, tokens):
    monkeypatch.setattr(jaccard, "TOKENS", tokens)
    rng = random.Random(11)
    said = [t for _, t in keyed if t]
    texts = [*said, *(" ".join(w for w in said[i % len(said)].split() if rng.random() > 0.02) for i in range(120))]
    sets, group = groups_of(texts, 5, 80)
    got = {r.doc_id: r for r in jaccard.components(frame(spark, list(enumerate(texts))), Scratch(spark, "t"), words=5, percent=80).collect()}
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), first[g]) for s, g in zip(sets, group, strict=True)]


# Suffixes of string keys


def test_suffixes_of_string_keys(spark, keyed):
    rows = [(None if k is None else f"k{k}", t) for k, t in keyed]
    got = suffix_dedup.dedup(frame(spark, rows, "string").repartition(3), Scratch(spark, "t"), texts=False)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    seen, kept = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or "")):
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(raw[i : i + 100])
        kept.append((k, len(raw), len(gone), hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()))) == sorted(map(repr, kept))


# Language


def test_language_equals_exact_counts(spark):
    """Against sets of trigrams without a filter, on real texts: the same language for all but a few."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = [r for r in df.where(~langid.is_held_out()).collect() if r.lang and r.text]
    per = {}
    for r in train:
        codes, n = np.unique(langid.trigrams([r.text])[0], return_counts=True)
        for c, k in zip(codes.tolist(), n.tolist(), strict=True):
            per.setdefault(r.lang, {}).setdefault(c, 0)
            per[r.lang][c] += k
    share = {x: {c: k / sum(g.values()) for c, k in g.items()} for x, g in per.items()}
    top = {}
    for g in share.values():
        for c, k in g.items():
            top[c] = max(top.get(c, 0), k)
    sets = {x: {c for c, k in g.items() if k >= langid.SHARE * top[c]} for x, g in share.items()}
    found = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), langid.fit(df.where(~langid.is_held_out()))).collect()}
    same = total = 0
    for r in df.collect():
        codes = langid.trigrams([r.text or ""])[0].tolist()
        if codes:
            counts = {x: sum(c in s for c in codes) for x, s in sets.items()}
            total += 1
            same += counts[found[r.doc_id].lang_pred] == max(counts.values())
    assert same >= 0.98 * total


def test_language_columns(spark):
    df = frame(spark, KEYS)
    model = langid.Model(["aa"], np.full((1, langid.SLOTS), 1, np.uint64), np.zeros(1))
    assert langid.predict(df, model).columns == [*df.columns, "lang_pred", "score"]
    assert sorted(map(repr, langid.shows(df, model).collect())) == sorted(map(repr, df.where("text rlike '[a-z]'").collect()))
    with pytest.raises(ValueError, match="spans"):
        langid.predict(df, model, lang="spans")


# Toxicity


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    model = toxicity.CharModel(np.log(rng.dirichlet(np.ones(toxicity.ALPHABET), (toxicity.ALPHABET, toxicity.ALPHABET))).tolist())
    pick = random.Random(5)
    for _ in range(200):
        steps = [[("".join(pick.choices("abc ", k=pick.randint(0, 2))), -pick.random() * 5) for _ in range(pick.randint(1, 4))] for _ in range(pick.randint(1, 6))]

        def score(path):
            p, q, total = toxicity.EDGE, toxicity.EDGE, 0.0
            for letters, cost in path:
                total += cost
                for x in letters:
                    k = toxicity._class_of(x)
                    total += model.logs[p][q][k]
                    p, q = q, k
            return total + model.logs[p][q][toxicity.EDGE]

        best = max(map(score, itertools.product(*steps)))
        said = model.best(steps)
        assert max(score(p) for p in itertools.product(*steps) if "".join(x for x, _ in p) == said) == pytest.approx(best)


def test_odd_texts_end_soon():
    import time

    model, began = toxicity.CharModel.of(np.ones([toxicity.ALPHABET] * 3)), time.time()
    for text in ("a.." * 22 + "!!", "a.." * 40 + "!!", "a.." * 300_000, "a..-" * 100_000 + "\n", "!a!" * 100_000):
        for t in toxicity._tokens(text, True):
            toxicity.restore(t, model)
    assert time.time() - began < 60


def test_toxicity_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.fit(frame(spark, []), labels, Scratch(spark, "t"))
    assert toxicity.predict(frame(spark, []), scorer).count() == 0
    assert toxicity.predict(frame(spark, KEYS), scorer).count() == len(KEYS)
    with pytest.raises(ValueError, match="spans"):
        toxicity.predict(frame(spark, KEYS), scorer, out="spans")


# Sharding


def test_sharding_of_odd_keys(spark):
    rows = [(None, "same")] * 30 + [(5, None)] * 7 + [(6, "")] * 5 + [(i % 40, f"text {i // 3}") for i in range(300)]
    placed = Scratch(spark, "t").save(sharding.place(frame(spark, rows).repartition(5), Scratch(spark, "t"), shards=6), "placed")
    got = placed.collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    cut = sharding.cut_links(placed).first()
    # All rows are linked here, so none can make room; by hash alone some 180 rows would lie apart.
    assert cut.linked == 335 and cut.cut <= 60


def test_sharding_of_a_hot_text(spark):
    rows = [(i, "hot") for i in range(900)] + [(900 + i, f"pair {i // 2}") for i in range(1800)]
    got = sharding.place(frame(spark, rows), Scratch(spark, "t"), shards=24)
    sizes = [r[1] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    cut = sharding.cut_links(got).first()
    assert cut.cut <= 900 - len(rows) // 24 + 0.05 * 1800


# Secrets


def test_secrets_pass_columns_on(spark):
    df = frame(spark, [*KEYS, (8, "token: abcdefgh x")])
    hidden = secrets.redact(df)
    assert hidden.schema == df.schema and hidden.where("text = '[assign] x'").count() == 1 and hidden.count() == len(KEYS) + 1
    assert secrets.redact(df.limit(0)).count() == 0


# The registered queries

COLUMNS = {
    "op1_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of the smallest table, some rows without text or language, one written twice; no labels for one of them."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, "s", None), (10_002, "", "en", None, 0), (10_003, "12 34 .", "en", "s", 7)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{at}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    kinds = dict(got.dtypes)
    for c in COLUMNS[name].split(", "):
        assert kinds[c.split()[0]] == c.split()[1], c
    rows = {r.doc_id: r for r in got.collect()}
    said = {r.doc_id: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert rows.keys() == said.keys()
    if name == "op4_language":
        assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
        assert {rows[i].lang_pred for i in (10_001, 10_002, 10_003)} == {"und"}
        sure = [rows[i].lang_pred == r.lang for i, r in said.items() if r.lang and rows[i].held_out and rows[i].lang_pred != "und"]
        assert sum(sure) >= 0.95 * len(sure)
    if name == "op6_secrets":
        assert all(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in secrets.base_spans(r.text or "")).encode()).hexdigest() == rows[i].base_sha256 for i, r in said.items())
    if name == "op7_toxicity":
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    if name == "op10_jaccard":
        ids = sorted(said)
        sets, group = groups_of([said[i].text for i in ids], 3, 90)
        assert [(rows[i].n_shingles, rows[i].component_id) for i in ids] == [(len(s), ids[g]) for s, g in zip(sets, group, strict=True)]


# The pipeline


def test_pipeline_equals_brute_force(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs.where(~langid.is_held_out()))
    left = {i: t for i, t in rows.items() if model.predict([t])[0][1] > 0}
    assert rows.keys() - left.keys() >= {10_001, 10_002, 10_003}
    ids = sorted(left)
    _, group = groups_of([left[i] for i in ids], 5, 80)
    left = {i: left[i] for i, g in zip(ids, group, strict=True) if ids[g] == i}
    bench = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[s : s + 10]) for _, t in bench if (w := words(t)) for s in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    left = {i: t for i, t in left.items() if not any(tuple(w[s : s + n]) in windows for w in [words(t)] for s in range(len(w)) for n in sizes)}
    signs = secrets.fit(spark.createDataFrame([(t,) for t in left.values()], "text string"))
    left = {i: secrets._mask(t, secrets.spans_of(t, signs)[1], "[{}]") for i, t in left.items()}
    lib = Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))
    wanted = {}
    for i, t in left.items():
        got = lib.encode(t, add_special_tokens=False).ids
        wanted[i] = (len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, tables).collect()}
    assert 0 < len(found) < len(rows) - 3 and found == wanted


def test_pipeline_of_nothing_and_of_odd_keys(spark, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(None, "alpha beta", "en", "s", 10), (1, "gamma delta", "en", "s", 11), (1, "gamma delta", None, None, None), (1, "epsilon zeta eta theta", "en", "s", 3), (2, None, "en", "s", 0)])):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        got = sorted(((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, at).collect()), key=repr)
        assert [i for i, _ in got] == ([] if name == "none" else [1, 1, None])
