"""Operators without SQL against brute force, calibration and rejection of languages, and edges of single operators."""

import hashlib
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

import corpus_pipeline
from flowloom.llm import importance, langid, learn, leaks, licenses, mixing, toxicity, urls, warc

SF = "/root/testdata/sf0.001"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_ftrl_against_plain_python():
    draw = np.random.default_rng(3)
    rows = [({int(s): float(v) for s, v in zip(draw.choice(6, 3, replace=False), draw.normal(size=3), strict=True)}, int(draw.integers(3))) for _ in range(40)]
    model = learn.FTRL(6, 3, alpha=0.4, beta=1.0, l1=0.5, l2=0.1)
    z, n = Counter(), Counter()

    def weight(s, c):
        if abs(z[s, c]) <= 0.5:
            return 0.0
        return -(z[s, c] - math.copysign(0.5, z[s, c])) / ((1.0 + math.sqrt(n[s, c])) / 0.4 + 0.1)

    for values, label in rows:
        slots = np.array(list(values))
        model.fit_row(slots, np.array(list(values.values())), label)
        full = {**values, 6: 1.0}
        scores = [sum(v * weight(s, c) for s, v in full.items()) for c in range(3)]
        chance = [math.exp(x) / sum(map(math.exp, scores)) for x in scores]
        steps = [(s, c, v * (chance[c] - (c == label)), weight(s, c)) for s, v in full.items() for c in range(3)]
        for s, c, g, w in steps:
            z[s, c] += g - (math.sqrt(n[s, c] + g * g) - math.sqrt(n[s, c])) / 0.4 * w
            n[s, c] += g * g
    got = model.weights(slice(None))
    assert np.allclose(got, [[weight(s, c) for c in range(3)] for s in range(7)], atol=1e-12) and (got == 0).any()


def test_temperature():
    scores, labels = np.array([[9.0, 0.0], [0.0, 9.0]] * 50), np.array([0, 1] * 50)
    # all rows are right: the chance is that of one wrong row more
    chance = learn.softmax(scores / learn.temperature(scores, labels)).max()
    assert abs(chance - (1 - 1 / 102)) < 1e-4
    wrong = labels.copy()
    wrong[:20] = 1 - wrong[:20]
    assert abs(learn.softmax(scores / learn.temperature(scores, wrong)).max() - 0.8) < 0.02
    assert learn.temperature(np.zeros((0, 2)), np.zeros(0, int)) == learn.temperature(np.zeros((4, 2)), np.zeros(4, int)) == 1.0


def test_unlearned_languages_and_gibberish_are_not_known(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert 0.2 < model.temperature < 5
    out = langid.predict(docs.withColumnRenamed("source", "known_text"), model, known="known_text")
    assert out.filter("not known_text").count() == 0 and out.filter("lang <> lang_pred").count() == 0
    draw = np.random.default_rng(1)
    noise = [("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400)),) for _ in range(50)]
    texts = spark.createDataFrame([*noise, (None,), ("123",), ("the",)], "text string")
    assert [r.k for r in langid.predict(texts, model, known="k").collect()] == [False] * 52 + [True]
    without = langid.predict(docs, langid.fit(docs.filter("lang <> 'fr'")), known="k")
    left, kept = without.filter("lang = 'fr'"), without.filter("lang <> 'fr'")
    assert left.filter("k").count() <= 0.1 * left.count() and kept.filter("not k").count() == 0
    assert not any(r.k for r in langid.predict(texts, langid.fit(docs.limit(0)), known="k").collect())


HEADERS = {
    "Apache-2.0": '// Copyright 2020 Some One\n//\n// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Copyright (c) 2020, Some One\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.",
    "CC-BY-4.0": "# This work is licensed under a\n# Creative Commons Attribution 4.0\n# International License.",
    "CC-BY-NC-4.0": "notes\nLicensed under CC BY-NC 4.0.\nmore notes",
    "GPL": " * You can redistribute it\n * and/or modify it under the terms of the\n * GNU General Public License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MIT": 'Copyright (c) 2020 Some One\nAll rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.',
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "Proprietary": "Copyright 2020 Some One.\nAll rights reserved.",
}


def plain_scan(files):
    """Licences by dictionaries of word counts over all segments, and a walk up the path."""
    words = lambda s: regex.findall(r"[\p{L}\p{N}]+", s.lower())
    segments = {}
    for key, _, text in files:
        lines = regex.split(licenses.LINE, text or "")
        segments[key] = [w for s in [*lines, *[s for s in regex.split(licenses.PARAGRAPH, text or "") if "\n" in s]] if (w := words(s))]
    every = [set(s) for own in segments.values() for s in own]
    vocabulary = {w for texts in licenses.TEMPLATES.values() for t in texts for w in words(t)}
    df = Counter(w for s in every for w in s if w in vocabulary)
    # a segment that is only blanks or marks counts as one in the operator as well
    blanks = sum(1 for _, _, text in files for s in [*regex.split(licenses.LINE, text or ""), *[s for s in regex.split(licenses.PARAGRAPH, text or "") if "\n" in s]] if s and not words(s))
    n = len(every) + blanks
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    vector = lambda s: {w: c * idf(w) for w, c in Counter(s).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    found = {}
    for key, _, _ in files:
        best = []
        for own in map(vector, segments[key]):
            for name, texts in licenses.TEMPLATES.items():
                for template in (vector(words(t)) for t in texts):
                    cosine = round(sum(x * template.get(w, 0) for w, x in own.items()) / length(own) / length(template), 9)
                    if cosine >= licenses.COSINE:
                        best.append((name in licenses.GENERIC, -cosine, name))
        found[key] = min(best) if best else None
    holders = {}
    for key, path, _ in files:
        if path is not None and regex.search(licenses.LICENSE_FILE, path.rsplit("/", 1)[-1]) and found[key]:
            folder = path.rpartition("/")[0]
            holders[folder] = min(holders.get(folder, found[key]), found[key])
    out = {}
    for key, path, _ in files:
        own, how = found[key], "own"
        folder = path.rpartition("/")[0] if path else ""
        while own is None and path:
            own, how = holders.get(folder), "directory"
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        out[key] = (own[2], round(-own[1], 6), how) if own else None
    return out


def test_licences_of_real_headers(spark):
    rows = [(i, f"p/{i}.c", text) for i, text in enumerate(HEADERS.values())] + [(50 + i, "q/x", f"plain words number {i}\nof no licence") for i in range(60)]
    out = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert [out[i].license for i in range(len(HEADERS))] == list(HEADERS) and all(out[50 + i].license is None for i in range(60))


def test_licences_against_brute_force(spark):
    texts = list(HEADERS.values())
    names = ("LICENSE", "a.txt", "b/COPYING", "b/c/d.txt", "b/c/LICENSE-1", "b/c/e/f.txt")
    files = [(i, f"r{i % 7}/{names[i % 6]}", [texts[i % len(texts)], "some words\nand more.", None, "", "...\n\n***", texts[(i * 3) % len(texts)] + "\nAll rights reserved."][i * 7 % 6]) for i in range(90)]
    files += [(200, None, texts[1]), (201, None, "x"), (202, "r1/LICENSE", texts[2]), (203, "r1/LICENSE", texts[2])]
    out = by_id(licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string").selectExpr("*", "1 as License", "2 as cosine")))
    got = {i: (r.license, round(r.cosine, 6), r.found) if r.license else None for i, r in out.items()}
    assert got == plain_scan(files) and {"own", "directory"} <= {g[2] for g in got.values() if g}


def test_importance_against_brute_force(spark):
    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 9 if i % 2 else 14, draw.integers(1, 12))) for i in range(60)]
    target = set(range(0, 60, 2))
    raw, wanted = Counter(), Counter()
    for i, text in enumerate(texts):
        words = text.split()
        grams = [*words, *zip(words[:-1], words[1:], strict=True)]
        raw.update(grams)
        wanted.update(grams if i in target else [])
    log = lambda c, g: math.log((c[g] + importance.SMOOTHING) / (c.total() + importance.SMOOTHING * importance.SLOTS))
    keys = {}
    for i, text in enumerate(texts):
        words = text.split()
        weight = sum(log(wanted, g) - log(raw, g) for g in [*words, *zip(words[:-1], words[1:], strict=True)])
        u = max(int(hashlib.md5(f"{importance.SEED}|{i}".encode()).hexdigest()[:12], 16) / 2**48, 2.0**-49)
        keys[i] = (weight, weight - math.log(-math.log(u)))
    cut = sorted((k for _, k in keys.values()), reverse=True)[29]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, Selected double")
    out = by_id(importance.resample(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")))
    # grams that share a slot would differ; these don't
    assert all(abs(out[i].log_weight - w) < 1e-9 and abs(out[i].gumbel_key - k) < 1e-9 for i, (w, k) in keys.items())
    assert {i for i, r in out.items() if r.selected} == {i for i, (_, k) in keys.items() if k >= cut}


def test_fewer_false_positives_on_neutral_mentions():
    draw = np.random.default_rng(5)
    # words of random letters, as stems are features too
    words, bad = (["".join(draw.choice(list("abcdefghij"), 7)) for _ in range(n)] for n in (300, 40))

    def row(words, y):
        found, _, size = toxicity.features_of(pa.array([" ".join(words)]))
        f, n = np.unique(found, return_counts=True)
        return f, n.astype(np.int32), int(size[0]), y

    def sentence(*more):
        return [*draw.choice(words, 8), *more]

    # most toxic sentences name a group, few clean ones do
    hostile = [sentence(str(draw.choice(bad)), *(["muslim"] if i % 5 else [])) for i in range(500)]
    examples = [row(words, 1) for words in hostile[:300]]
    examples += [row(sentence(*(["christian"] if i % 10 == 0 else [])), 0) for i in range(600)]
    groups = [toxicity.hashes_of_terms(line) for line in toxicity.IDENTITY_TERMS]
    neutral = pa.array([" ".join(sentence("muslim")) for _ in range(200)])
    toxic = pa.array([" ".join(words) for words in hostile[300:]])
    rates = []
    for weight in (0.0, 4.0):
        toxicity.SWAP_WEIGHT, before = weight, toxicity.SWAP_WEIGHT
        model = toxicity._train(examples, groups, 0.5)
        toxicity.SWAP_WEIGHT = before
        # at equal recall: the cut that finds nine tenths of the toxic ones
        cut = np.quantile(toxicity.scores_of(toxic, model), 0.1)
        rates.append((toxicity.scores_of(neutral, model) >= cut).mean())
    assert rates[1] < rates[0]


def test_fits_leave_only_a_model_to_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "you vile trash" if i % 2 else "a kind word", "de" if i % 3 else "en") for i in range(60)], "doc_id long, text string, lang string")
    marks = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    frame, brought = type(docs), []
    for name in ("toArrow", "toPandas", "collect"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): (brought.append(list(self.columns)), f(self))[1])
    model = toxicity.fit(docs, marks)
    assert (toxicity.scores_of(pa.array(["you vile trash", "a kind word"]), model) >= 0.5).tolist() == [True, False]
    assert langid.fit(docs).languages == ["de", "en"]
    # the rows of the sample, their features and texts stay with the tasks
    assert not [c for c in brought if {"slots", "row", "counts", "t"} & set(c)] and ["features", "weights", "intercept"] in brought


def test_pipeline_finds_leaks_without_a_sample(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(leaks, "fit_rows", lambda *_: pytest.fail("a sample of the documents"))
    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"a b {item} c"), (None, "a b c"), (7, None)], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a b c"), (7, None)]


def test_words_are_looked_up_once_for_all_blocks(monkeypatch):
    draw = np.random.default_rng(8)
    words = np.unique(draw.integers(0, 2**64, 5000, dtype=np.uint64))
    edge = np.array([0, 2**64 - 1], dtype=np.uint64)
    seen = np.concatenate([draw.choice(words, 3000), draw.integers(0, 2**64, 3000, dtype=np.uint64), words[:3] + np.uint64(1), edge])
    for listed in (words, words[:1], words[:0], np.union1d(words, edge), words >> np.uint64(40)):
        hit, place = pickle.loads(pickle.dumps(leaks.Lookup.of(np.unique(listed)))).hits(seen)
        assert (hit == np.flatnonzero(np.isin(seen, listed))).all() and (np.unique(listed)[place] == seen[hit]).all()
    texts = [" ".join(f"v{x}" for x in draw.integers(0, 900, n)) for n in draw.integers(15, 40, 3 * leaks.FIT_ITEMS)]
    items = [leaks.words_of(pa.array([t]))[0] for t in texts]
    vocabulary = np.unique(np.concatenate(items))
    corpus = leaks.Corpus(vocabulary, np.ones(len(vocabulary), dtype=np.int64), np.zeros((len(vocabulary), leaks.BUCKETS)), 9)
    blocks = [leaks.build(items[i : i + leaks.FIT_ITEMS], corpus) for i in range(0, len(items), leaks.FIT_ITEMS)]
    index = leaks.Index(*leaks.short_items(items), leaks.Lookup.of(vocabulary), blocks, list(range(len(items))), items)
    calls, hits = [], leaks.Lookup.hits
    monkeypatch.setattr(leaks.Lookup, "hits", lambda self, w: calls.append(len(w)) or hits(self, w))
    found = leaks.matches(pa.array([*texts, None, "", "other words"]), index)
    assert [f.get(i) for i, f in enumerate(found[:-3])] == [1.0] * len(texts) and found[-3:] == [{}] * 3
    assert calls == [sum(len(i) for i in items) + 2]


def test_block_sums_and_words_near_a_candidate():
    draw = np.random.default_rng(9)
    owner, scores = np.sort(draw.integers(0, 300, 2000)), draw.standard_normal((50, 7)).astype(np.float32)
    at = draw.integers(0, 50, 2000)
    expected = np.zeros((310, 7), dtype=np.float32)
    np.add.at(expected, owner, scores[at])
    assert (leaks.latent(owner, at, 310, scores) == expected).all() and not leaks.latent(owner[:0], at[:0], 310, scores).any()
    slots = draw.integers(0, 51, 4000).astype(np.int32)
    own = [draw.integers(0, 50, n) for n in draw.integers(8, 30, 20)]
    begin, item = draw.integers(0, 3900, 500), draw.integers(0, 20, 500)
    near = np.stack([begin, begin + draw.integers(1, 90, 500)], axis=1)
    brute = [2 * np.isin(own[i], slots[a:b]).sum() >= len(own[i]) for i, (a, b) in zip(item, near, strict=True)]
    assert leaks.holding(slots, near, item, own, 50).tolist() == brute and 0 < sum(brute) < 500
    # many words or long ranges: a few candidates at a time
    assert (leaks.holding(slots, near, item, own, 1 << 20) == brute).all()


def test_leak_of_an_item_without_id(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {item} c", 5), (2, "a b c", 6), (1, item, 7), (None, item, 8)], "doc_id long, text string, Items int")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    flagged = leaks.flag(docs, bench)
    assert sorted((r.doc_id or 0, r["items"], r.contaminated) for r in flagged.collect()) == [(0, [], True), (1, [], True), (1, [], True), (2, [], False)]
    assert [r.doc_id for r in leaks.clean(docs, bench).collect()] == [2] and leaks.clean(docs, bench).columns == docs.columns
    short = spark.createDataFrame([(None, "q3 q4 q5")], "item_id long, text string")
    assert leaks.flag(docs, short).filter("contaminated").count() == 3


def test_urls_with_many_hosts_and_clashing_columns(spark):
    hosts = spark.range(100_000).selectExpr("concat('h', id, '.example.net', if(id % 2 = 0, '/', '')) as key", "'block' as verdict", "false as rule")
    entries = hosts.unionByName(urls.rule_entries(spark)).unionByName(spark.createDataFrame([(None, "block", True), ("", "block", True)], "key string, verdict string, rule boolean"))
    rows = [(i, f"http://{'www.' * (i % 3 == 0)}h{i}.example.net/{i}", "x", "y", "z") for i in range(0, 110_000, 1000)] + [(None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, _url string, Host string, whole_url string")
    out = urls.judge(pages, entries)
    assert {(r.page_id, r.verdict, r._url) for r in out.collect()} == {(i, "block" if i is not None and i < 100_000 else "allow", x) for i, _, x, _, _ in rows}
    joined = by_id(urls.judge_by_join(pages.filter("page_id is not null"), entries, [1, 4, 5, 6]), "page_id")
    assert {i: r.verdict for i, r in joined.items()} == {r.page_id: r.verdict for r in out.collect() if r.page_id is not None}


@pytest.mark.parametrize("key", [None, 7])
def test_rows_without_an_id_of_their_own_are_mixed_apart(spark, key):
    docs = spark.range(4000).selectExpr(f"cast({'null' if key is None else key} as long) as doc_id", "concat('text ', id) as text", "'s' as source", "1 as Copy")
    out = mixing.mix(docs, total=8000.0)
    assert out.select("shuffle_key").distinct().count() == out.count() and abs(out.count() - 8000) < 400
    assert len({r[0] for r in out.groupBy("text").count().select("count").collect()}) > 4


def test_records_have_ids_of_their_own(spark):
    big = "x" * 2000
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "a"), (2, "u\r\nv", big), (3, "w", big), (4, "w", big + "y"), (4, "w", big + "y"), (0, "w", big + "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as Digest", "2 as first")
    out = warc.read(warc.archive(pages))
    assert out.count() == len(rows) and sorted((r.page_id, r.refers_to) for r in out.filter("record_type = 'revisit'").collect()) == [(0, 4), (2, 3)]
    found = []
    for r in warc.planned(pages).collect():
        head, block = warc.parse(warc.record(*r, f"part/{len(found)}"))
        found.append(head)
        assert head["WARC-Type"] == "revisit" or warc.payload_of(block) == r.payload
    ids = [h["WARC-Record-ID"] for h in found]
    assert len(set(ids)) == len(ids)
    of = {h["X-Page-ID"]: h for h in found}
    assert of["2"]["WARC-Refers-To"] == of["3"]["WARC-Record-ID"] and of["2"]["WARC-Refers-To-Target-URI"] == "w"
    # two records are the response of page 4
    assert "WARC-Refers-To" not in of["0"] and of["0"]["WARC-Refers-To-Date"] == warc.DATE
