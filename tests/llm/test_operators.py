"""Edge cases and brute-force comparisons of the training-data operators."""

import math
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from flowloom.llm import embeddings, importance, jaccard, langid, leaks, licenses, mixing, toxicity, urls, warc
from flowloom.llm.common import connected_components
from flowloom.llm.queries import ORACLES, QUERIES
from registry.compare import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, rate string"
EN = "the cat and the dog were in the house with that other animal this morning"
DE = "der hund und die katze waren mit dem anderen tier heute morgen nicht im haus"


def docs_of(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else None, f"s{i % 2}" if i % 3 else None, 9.0, "x") for i, t in enumerate(texts)], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES.get(name)) is None


def test_language(spark):
    texts = [EN, DE] * 20 + [None, "", "123 ++ 4", EN * 500]
    docs = docs_of(spark, texts, ["en", "de"] * 20 + [None] * 4)
    out = by_id(langid.predict(docs, langid.fit(docs)))
    assert out[0].lang_pred == "en" and out[1].lang_pred == "de" and out[43].lang_pred == "en"
    assert [out[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and out[40].score == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and out[0].rate == "x"
    empty = langid.predict(docs, langid.fit(docs.limit(0)))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def test_toxicity(spark):
    clean, bad = "the weather was good and we went out", "you are a stupid idiot and we went out"
    texts = [clean + f" w{i}" for i in range(40)] + [bad + f" w{i}" for i in range(40)] + [None, "", bad, clean + " muslim", "long " * 20000 + bad]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    out = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert out[82].score >= 0.5 > out[83].score and all(r.score is not None for r in out.values())
    kept = toxicity.score(docs, toxicity.fit(docs, labels), below=0.5)
    assert set(by_id(kept)) == {i for i, r in out.items() if r.score < 0.5}
    base = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, base).collect())
    assert toxicity.score(docs.limit(0), base).count() == 0


def test_fits_take_their_full_samples():
    assert (langid.FIT_ROWS, toxicity.FIT_TOXIC, toxicity.FIT_CLEAN) == (6_000, 1_500, 3_000)


def test_identity_swaps_shrink_their_weight():
    def row(words, y):
        found, _, size = toxicity.features_of(pa.array([words]))
        f, n = np.unique(found, return_counts=True)
        return f, n.astype(np.int32), int(size[0]), y

    examples = [row(f"they muslim said bad{i} word", 1) for i in range(60)] + [row(f"they said good{i} word", 0) for i in range(60)]
    groups = [toxicity.hashes_of_terms("muslim christian")]
    gap = []
    for weight in (0.0, 4.0):
        toxicity.SWAP_WEIGHT, before = weight, toxicity.SWAP_WEIGHT
        model = toxicity._train(examples, groups, 1.0)
        toxicity.SWAP_WEIGHT = before
        a, b = toxicity.scores_of(pa.array(["they muslim said word", "they christian said word"]), model)
        gap.append(abs(a - b))
    assert gap[1] < gap[0]


def test_swaps_are_keyed_by_whole_words():
    ways = toxicity.swap_ways([toxicity.hashes_of_terms(line) for line in toxicity.IDENTITY_TERMS])
    whole = lambda word: int(toxicity.words_of(pa.array([word]))[0][0])
    terms = {word for line in toxicity.IDENTITY_TERMS for word in line.split()}
    assert set(ways) == {whole(word) for word in terms} and not {whole("turkey"), whole("blacken")} & set(ways)
    # muslim is on the English and on the German line
    assert len(ways[whole("christian")]) == 5 and len(ways[whole("muslim")]) == 7
    found, n = np.unique(toxicity.features_of(pa.array(["a man saw a man"]))[0], return_counts=True)
    man, boy = (toxicity.hashes_of_terms(word)[0] for word in ("man", "boy"))
    change = toxicity.swap_change(found, n, 5, 2, man, boy)
    assert np.allclose(change, [np.log(3), 3.0, -np.log(3), -3.0])


def naive_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(sets)
    link = [[i != j and bool(sets[i] & sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return {i: (root[i], sum(link[i])) for i in range(n)}


def test_jaccard_against_brute_force(spark):
    draw = np.random.default_rng(3)
    texts = []
    for size in (1, 2, 3, 40):
        base = [f"w{x}" for x in draw.integers(0, 500, 150)]
        for _ in range(size):
            own = list(base)
            for at in draw.integers(0, 150, draw.integers(0, 5)):
                own[at] = f"x{draw.integers(0, 9999)}"
            texts.append(" ".join(own))
    texts += [None, "", "one", "one", "One two!", texts[0], texts[-1], "!!!", "a b c d e " * 3000]
    for small, block in ((24, 2048), (4, 16)):
        jaccard.SMALL, jaccard.BLOCK_SETS, before = small, block, (jaccard.SMALL, jaccard.BLOCK_SETS)
        out = by_id(jaccard.near_duplicates(docs_of(spark, texts)))
        jaccard.SMALL, jaccard.BLOCK_SETS = before
        assert {i: (r.component_id, r.n_links) for i, r in out.items()} == naive_links(texts)
    repeated = docs_of(spark, [texts[0], texts[0], "other words are here in this text"]).withColumn("doc_id", pyspark_lit(spark, 7))
    rows = jaccard.near_duplicates(repeated).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in rows) == [(7, 7, 0), (7, 7, 1), (7, 7, 1)]
    assert jaccard.near_duplicates(repeated.limit(0)).count() == 0


def pyspark_lit(spark, value):
    from pyspark.sql import functions as F

    return F.lit(value).cast("long")


def test_embeddings_against_brute_force(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((30, 8))
    rows = [(i, (base[i % 30] + draw.standard_normal(8) * 0.08 * (i % 4)).tolist(), i % 2) for i in range(120)]
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [float("nan")] * 8, 0), (203, [None] * 8, 0), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    out = by_id(embeddings.near_duplicates(df), "vec_id")
    ok = {i: (np.array(v), lab) for i, v, lab in rows + odd[5:]}
    cos = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98
    links = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and cos(ok[i][0], ok[j][0])} for i in ok}
    assert {i: out[i].n_links for i in ok} == {i: len(x) for i, x in links.items()}
    root = {i: i for i in ok}
    for _ in ok:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in ok}
    assert {i: out[i].component_id for i in ok} == root
    assert all(out[i].n_links == 0 and out[i].kept for i in (200, 201, 202, 203, 204))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(3, 1), (1, 3), (4, 4), (None, 2)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 50 for i in range(50, 91)} | {1: 1, 3: 1}


def test_licenses(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.txt", "some text"), (3, "a/b/COPYING", "Released under the MIT License."),
        (4, "a/b/c/y.txt", None), (5, "z/y.txt", ""), (6, "a/b/own.txt", "hello\nLicensed under CC BY-NC 4.0.\n" + "the of and " * 5000), (7, None, "text"), (8, "a/z.txt", "the license of the cat"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = by_id(licenses.scan(df))
    assert {i: (r.license, r.found) for i, r in out.items()} == {
        1: ("Apache-2.0", "own"), 2: ("MIT", "directory"), 3: ("MIT", "own"), 4: ("MIT", "directory"), 5: (None, None),
        6: ("CC-BY-NC-4.0", "own"), 7: (None, None), 8: ("Apache-2.0", "directory"),
    }
    assert out[8].from_dir == "a" and licenses.scan(df.limit(0)).count() == 0


def test_importance(spark):
    good, poor = "clear careful words explain it", "buy cheap pills click here now"
    docs = docs_of(spark, [good] * 30 + [poor] * 30 + [None, ""])
    target = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    rows = by_id(importance.resample(docs, target))
    assert sum(r.selected for r in rows.values()) == 31 and not any(rows[i].selected for i in range(30, 60)) and rows[60].log_weight == 0
    keys = spark.range(5000).selectExpr("double(pmod(id * 7919, 5000)) as x")
    importance.EXACT_ROWS, before = 50, importance.EXACT_ROWS
    assert [importance.kth_largest(keys, "x", k) for k in (1, 777, 5000)] == [4999.0, 4223.0, 0.0]
    importance.EXACT_ROWS = before
    assert importance.resample(docs.limit(0), target).count() == 0


def test_leaks(spark):
    item = " ".join(f"q{i}" for i in range(30))
    other = " ".join(f"z{i}" for i in range(40))
    words = item.split()
    para = " ".join(w if i % 4 else f"syn{i}" for i, w in enumerate(words[:-6])) + " " + " ".join(words[-6:])
    filler = " ".join(f"f{i % 97}" for i in range(300))
    docs = docs_of(spark, [f"{filler} {item} {filler}", f"{filler} {para} {filler}", filler, None, "", other, " ".join(words[:12]), f"{item} {other}"])
    bench = spark.createDataFrame([(5, item), (6, other), (7, None), (8, "!!")], "item_id long, text string")
    out = by_id(leaks.flag(docs, bench))
    assert {i: r["items"] for i, r in out.items()} == {0: [5], 1: [5], 2: [], 3: [], 4: [], 5: [6], 6: [], 7: [5, 6]}
    assert set(by_id(leaks.clean(docs, bench))) == {2, 3, 4, 6} and leaks.clean(docs, bench).columns == docs.columns
    assert leaks.flag(docs, bench.limit(0)).filter("contaminated").count() == 0 and leaks.flag(docs.limit(0), bench).count() == 0


def test_leaks_of_a_large_benchmark(spark):
    draw = np.random.default_rng(4)
    chance = 1 / np.arange(10, 4010)
    texts = [[f"v{x}" for x in draw.choice(4000, n, p=chance / chance.sum())] for n in draw.integers(15, 60, 1000)]
    docs = []
    for i in draw.permutation(1000)[:60]:
        own = [w if len(docs) % 2 or j % 5 else f"syn{j}" for j, w in enumerate(texts[i])]
        before, after = ([f"v{x}" for x in draw.choice(4000, n, p=chance / chance.sum())] for n in draw.integers(0, 60, 2))
        docs.append(" ".join([*before, *own, *after]))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    out = by_id(leaks.flag(docs_of(spark, docs), bench))
    hashed = [leaks.words_of(pa.array([" ".join(t)]))[0] for t in texts]
    expected = {(d, i) for d, t in enumerate(docs) for w in [leaks.words_of(pa.array([t]))[0]] for i, item in enumerate(hashed) if np.isin(item, w).mean() >= 0.5 and leaks.is_leak(item, w)[0]}
    got = {(d, i) for d, r in out.items() for i in r["items"]}
    assert len(expected) >= 60 and len(got & expected) >= 0.9 * len(expected) and got <= expected


def test_sample_is_drawn_in_the_tables_own_tasks(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(leaks, "saved", lambda df, purpose: plans.append(df._jdf.queryExecution().toString()) or df)
    leaks.fit_rows(docs_of(spark, [EN] * 9), 9, "text", "doc_id")
    assert "Coalesce" not in plans[0] and "Exchange RoundRobin" in plans[0]


def test_every_passage_is_in_the_fit(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 400}" for j in range(n)) for i, n in enumerate(range(1, 300))]
    docs = spark.createDataFrame([(None if i % 3 else 1, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    vocabulary = np.unique(leaks.words_of(pa.array([" ".join(f"w{i}" for i in range(0, 400, 2))]))[0])
    held, gram = np.zeros(200), np.zeros((200, 200))
    for t in texts:
        words = leaks.words_of(pa.array([t]))[0]
        held += np.isin(vocabulary, words)
        for begin in range(0, max(len(words) - leaks.STRIDE, 1), leaks.STRIDE):
            near = words[begin : begin + 2 * leaks.STRIDE]
            row = (near[:, None] == vocabulary).sum(axis=0)
            gram += np.outer(row, row) / max(row.sum(), 1)
    one, many = (leaks.corpus_of(docs.repartition(n), vocabulary, "text", "doc_id") for n in (1, 5))
    assert one.n_docs == 301 and (one.frequency == held).all() and (many.frequency == held).all()
    assert np.allclose(one.sketch, many.sketch, atol=1e-4) and one.sketch.any(axis=1).all()
    # the sketch has the passages' products in the mean
    assert 0.8 < np.trace(one.sketch @ one.sketch.T) / np.trace(gram) < 1.25
    top = np.linalg.eigh(gram)[1][:, -1]
    assert 0.7 < (top @ one.sketch @ one.sketch.T @ top) / (top @ gram @ top) < 1.4


def test_leaks_of_short_items(spark):
    draw = np.random.default_rng(6)
    chance = 1 / np.arange(10, 1010)
    prose = lambda n: [f"v{x}" for x in draw.choice(1000, n, p=chance / chance.sum())]
    texts = [prose(n) for n in range(1, 16) for _ in range(8)]
    docs = [" ".join([*prose(200), *t, *prose(200)]) for t in texts]
    docs.append(" ".join([*texts[24][:-1], "else", texts[24][-1]]))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, texts[30]])], "item_id long, text string")
    out = by_id(leaks.flag(docs_of(spark, docs), bench))
    got = {(d, i) for d, r in out.items() for i in r["items"]}
    assert {(i, i) for i in range(120)} <= got and (30, 120) in got
    # items under SHORT words are found where they occur whole, and nowhere else
    whole = {(d, i) for d, doc in enumerate(docs) for i, t in enumerate(texts) if len(t) < leaks.SHORT and f" {' '.join(t)} " in f" {doc} "}
    assert {(d, i) for d, i in got if i < 120 and len(texts[i]) < leaks.SHORT} == whole


@pytest.mark.parametrize(("a", "b", "n"), [([1, 2, 3], [1, 9, 2, 3], 3), ([1, 1, 2], [2, 1, 1], 2), ([1], [], 0), ([4, 3, 2, 1], [1, 2, 3, 4], 1)])
def test_subsequence(a, b, n):
    assert leaks.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == n


def test_mixing(spark):
    docs = docs_of(spark, ["t"] * 300 + [None])
    out = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, total=4000)
    counts = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert None not in counts and abs(counts["s0"] - 3000) < 250 and abs(counts["s1"] - 1000) < 150
    again = mixing.mix(docs.repartition(7), weights={"s0": 3.0, "s1": 1.0}, total=4000)
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, out.select("doc_id", "copy").collect()))
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    many = mixing.mix(docs.limit(1), total=100_000.0)
    assert abs(many.count() - 100_000) < 2000 and many.rdd.getNumPartitions() >= 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_urls(spark):
    rows = [None, "no scheme", "http://EXAMPLE.org/en/12?x", "http://a.example.org/es/", "http://x.com/fr/1", "http://x.com", "http://badexample.org/es/", "http://com/de/#f", "http://spam-farm.example.net/a", "HTTP://ü.net/é", "http:///p"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    entries = urls.rule_entries(spark)
    out = by_id(urls.judge(df, entries), "page_id")
    assert [out[i].rule for i in range(11)] == [None, None, "example.org/en/1", "example.org/es/", "com/fr/", None, "org/", "com/de/", None, None, None]
    assert [out[i].verdict for i in range(11)] == ["allow", "allow", "block", "block", "allow", "allow", "allow", "block", "block", "allow", "allow"]
    joined = by_id(urls.judge_by_join(df, entries, [1, 4, 5, 6]), "page_id")
    assert {i: (r.rule, r.verdict) for i, r in joined.items()} == {i: (r.rule, r.verdict) for i, r in out.items()}
    assert urls.judge(df.limit(0), entries).count() == 0 and urls.judge(df, entries.limit(0)).filter("verdict = 'block'").count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "ü<p>text</p>" * 200
    rows = [(1, "http://a", big), (2, "http://b", None), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e\r\nX: y", ""), (7, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.archive(df)
    out = by_id(warc.read(archives), "page_id")
    assert {i: out[i].record_type for i in out} == {1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response", 6: "response", 7: "response"}
    assert out[1].refers_to == 3 and out[1].payload is None and out[1].payload_bytes == len(big.encode())
    assert all((out[i].payload or b"").decode() == (h or "") for i, _, h in rows if i != 1)
    warc.export(archives, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert files and all(struct.unpack("<I", f.read_bytes()[:4])[0] == warc.DICTIONARY_MAGIC for f in files)
    assert warc.read(warc.archive(df.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
    assert corpus_pipeline.mixture(spark, kept, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(5).unionByName(nulls), SF).count()


def test_half_alike_texts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [" ".join(base + [f"w{x}" for x in rng.integers(0, 5000, 100)]) for _ in range(300)]
    texts += [texts[7], texts[8] + " end"]
    sizes, plain = {}, jaccard.saved

    def counted(df, purpose="table"):
        kept = plain(df, purpose)
        sizes.setdefault(purpose, []).append(kept.count() if purpose in ("members", "candidates") else 0)
        return kept

    monkeypatch.setattr(jaccard, "saved", counted)
    out = by_id(jaccard.near_duplicates(docs_of(spark, texts)))
    assert max(sizes["members"]) <= len(texts)
    # some of the cloud may be taken for a class (see the module), never more rows than sets
    assert sizes["candidates"] and max(sizes["candidates"]) <= len(texts)
    links = {i: (r.component_id, r.n_links) for i, r in out.items() if r.n_links}
    assert links == {7: (7, 1), 300: (7, 1), 8: (8, 1), 301: (8, 1)}


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (2, one), (2, other), (3, None), (3, None), (None, one), (4, ""), (1, one), (5, other + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ["n", "low", "high", "own_id", "words"]:
        df = df.withColumn(name, df["doc_id"])
    kept = jaccard.one_per_group(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (2, other), (3, None), (3, None), (None, one), (4, "")], key=str)
    assert jaccard.one_per_group(df.limit(0)).count() == 0
