"""URL filter, line dedup, sharding and licence scan against brute force, on nulls, empty texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import licence_texts, licences, line_dedup, queries, sharding, url_filter
from tests.compare import rows_of, rows_of_sql


def python_free(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_sql_agrees(spark, duck, sf):
    for name, sql in queries.ORACLE.items():
        if name in queries.QUERIES:
            assert rows_of(queries.QUERIES[name](spark, sf)) == rows_of_sql(duck, sql), name


# ---------------------------------------------------------------- URLs


def judged(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else None
    if rest is None:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, key=lambda f: (-f[0], f[1]), default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter_against_brute_force(spark):
    rules = queries.URL_RULES + [("block", "a.b.com", "/x/y"), ("allow", "b.com", "/x/"), ("block", "com", "/*skip/")]
    plain = [r for r in rules if "*" not in r[2]]
    rng = random.Random(0)
    urls = [None, "", "no scheme", "http://", "https://EXAMPLE.org", "http://example.org/es/1?q=/de/", "http://x.example.org/en/1234", "http://badexample.org/es/", "http://b.com/x/y", "a://b://example.org/es/", "http://a.b.com/x/yz#f", "http://com/de/", "http://x.com:80/de/", "http://é.com/de/a\nb"]
    urls += ["http://" + ".".join(rng.choice(["a", "b", "com", "org", "example", "fr"]) for _ in range(rng.randint(1, 4))) + "".join("/" + rng.choice(["x", "y", "de", "es", "fr", "en", "1"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", "?a=1"]) for _ in range(400)]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(0, None, "x", 1), (5, urls[5], "y", 2)]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string, host int")  # names that the result has too
    out = url_filter.judge(pages, url_filter.rules_frame(spark, plain))
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == collections.Counter((i, *judged(u, plain)) for i, u, *_ in rows)
    assert python_free(out)
    wild = url_filter.judge(spark.createDataFrame([(1, "http://q.com/abc/skip/x"), (2, "http://q.com/abc/skipped/")], "page_id int, url string"), url_filter.rules_frame(spark, rules)).collect()
    assert {r["page_id"]: r["verdict"] for r in wild} == {1: "block", 2: "allow"}
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_rules_sit_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, "http://a.com/common/") for i in range(9)] + [(10, "http://b.com/rare/")], "page_id int, url string")
    rows = pages.select(url_filter.url_tokens(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("_tokens"))
    index = url_filter.rule_index(url_filter.compiled(url_filter.rules_frame(spark, [("block", "com", "/rare/"), ("block", "com", "/common/x"), ("block", "", "/q")])), rows)
    assert {r["rules"][0]["rule"]: r["token"] for r in index.collect()} == {"com/rare/": "prare", "com/common/x": "pcommon", "/q": ""}


# ---------------------------------------------------------------- lines


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, least, keep_first):
    """Every row is a document; what becomes of each (id, text)."""
    docs = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen = collections.defaultdict(list)
    for n, (d, t) in enumerate(docs):
        for k in {key_of(x) for x in t.split("\n")} - {""}:
            seen[k].append(n)
    out = {}
    for n, (d, t) in enumerate(docs):
        kept, used = [], set()
        for line in t.split("\n"):
            k = key_of(line)
            if k and len(seen[k]) >= least:
                if not (keep_first and seen[k][0] == n and k not in used):
                    continue
                used.add(k)
            kept.append(line)
        out[d, t] = (t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["alpha", " Alpha\t", "beta", "BETA", "", "  ", "ünique", "Ünique", "long line " * 50, "x"]
    rows = [(i, "\n".join(rng.choice(pool) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (102, "alpha\n" * 3000), (103, "\n\n"), (None, "beta\nonly here")]
    docs = spark.createDataFrame([(d, t, 5, "h", 1) for d, t in rows], "doc_id int, text string, _hash int, drop_runs string, `n.lines` int")
    for keep_first, hot in ((False, 10_000), (False, 20), (True, 10_000), (True, 20)):
        out = line_dedup.dedup_lines(docs, 10, keep_first, hot_rows=hot)
        want = brute_lines(rows, 10, keep_first) if not keep_first else None
        got = out.collect()
        assert len(got) == len(rows) and python_free(out) and out.select("row.*").columns == docs.columns
        if not keep_first:
            texts = collections.Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["row"]["text"]) for r in got)
            assert texts == collections.Counter((d, *want[d, t or ""]) for d, t in rows)
        else:  # every frequent key is left exactly once
            left = collections.Counter(k for (d, t) in {(r["row"]["doc_id"], r["row"]["text"]) for r in got} for k in map(key_of, t.split("\n")))
            before = collections.defaultdict(list)
            for d, t in rows:
                for k in set(map(key_of, (t or "").split("\n"))):
                    before[k].append((d, t))
            for k, docs_of in before.items():
                if k and len(docs_of) >= 10:
                    assert left[k] == 1, k
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_documents(spark, duck, tmp_path):
    rows = [(i, f"shared\nown {i}") for i in range(8)] + [(8, "Shared \nshared")] * 2 + [(20 + i, f"rare\nx{i}") for i in range(8)] + [(30, "rare\nrare")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op7_line_dedup(spark, str(tmp_path)))
    here = duck.cursor()
    here.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == rows_of_sql(here, queries.ORACLE["op7_line_dedup"])
    brute = brute_lines(rows, 10, False)
    assert sorted((d, brute[d, t][1]) for d, t in rows) == sorted([(i, 1) for i in range(8)] + [(8, 2)] * 2 + [(20 + i, 0) for i in range(8)] + [(30, 0)])
    assert sorted((r["doc_id"], r["n_dropped"]) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()) == sorted((d, brute[d, t][1]) for d, t in rows)


def test_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(i, "a\nb\nkeep%d\nc" % i) for i in range(10)], "doc_id int, text string")
    runs = line_dedup.drop_bitmaps(docs, 10).collect()
    assert len(runs) == 10 and all([(x["first"], x["last"]) for x in r["drop_runs"]] == [(0, 1), (3, 3)] for r in runs)


# ---------------------------------------------------------------- shards


def test_sharding(spark):
    rows = [(i, "text %d" % i, "x") for i in range(2000)] + [(None, None, "y"), (5, "again", "z"), (3, "", "z"), (4, "é" * 70_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, shard string")
    out = sharding.shard_records(docs, [1.0] * 8, grown_weight=1.0, rows_per_task=64)
    got = out.collect()
    assert len(got) == len(rows) and python_free(out)
    text = collections.defaultdict(list)
    for d, t, _ in rows:
        text[d].append(t)
    for r in got:
        assert (r["size"], r["text_crc32"]) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r["doc_id"]]}
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 170 < len(slots) < 330
    moved = sum(r["grown_shard"] == 8 for r in got)
    assert abs(moved / len(got) - sharding.moved_share([1.0] * 8, 1.0)) < 0.03
    again = {r["doc_id"]: r["shard"] for r in sharding.shard_records(docs, [1.0] * 9).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in got)  # more shards: the same bids
    heavy = collections.Counter(r["shard"] for r in sharding.shard_records(docs, [3.0, 1.0, 0.0]).collect())
    assert heavy[2] == 0 and 2.4 < heavy[0] / heavy[1] < 3.8
    assert sharding.shard_records(docs.limit(0), [1.0]).count() == 0


def test_slots_depend_on_the_records_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = [(1, "same")] * 500 + [(1, f"other {i}") for i in range(300)] + [(i, "t") for i in range(50)] + [(None, None)] * 3
    given = collections.Counter((d, len(t or "") + 1) for d, t in rows)
    weights, found = [1.0] * 4, []
    for parts, per_task in ((1, 10_000), (5, 32)):
        docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(parts)
        found.append(sorted(map(str, sharding.shard_records(docs, weights, rows_per_task=per_task).collect())))
        got = sharding.shard_records(docs, weights, rows_per_task=per_task).collect()
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append((r["slot"], hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['size']}:{r['text_crc32']}".encode()).hexdigest()))
        assert all([n for n, _ in sorted(s)] == list(range(len(s))) and [h for _, h in sorted(s)] == sorted(h for _, h in s) for s in slots.values())
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == given
    assert found[0] == found[1]


# ---------------------------------------------------------------- licences


def plain_words(text):
    out, word = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + " ":
        if "a" <= c <= "z" or "0" <= c <= "9":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_scan(model, text):
    """(n_paragraphs, n_cued, n_licensed, licences, family, score) by plain loops over the model's numbers and the published texts."""
    lines = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split("\n")
    cues = set(licence_texts.CUES)

    def judge(paragraph):
        w = plain_words(paragraph)
        z = [float(v) for v in model.bias]
        for gram in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}:
            z = [a + float(b) for a, b in zip(z, model.weights[zlib.crc32(gram.encode()) % len(model.weights)])]
        order = sorted(range(len(z)), key=lambda k: (-z[k], k))
        own = {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

        def confirmed(k):
            wanted = [{" ".join(v[i : i + 3]) for i in range(len(v) - 2)} for v in map(plain_words, licence_texts.TEMPLATES.get(model.classes[k], []))]
            return any(len(want & own) >= max(min(2, len(want)), len(want) / 2) for want in wanted)

        sure = [k for k in order if confirmed(k)] if model.classes[order[0]] != "unknown" else []
        best = (sure or order)[0]
        return model.classes[best], math.exp(z[best]) / sum(math.exp(v) for v in z), bool(sure)

    has = [i for i, line in enumerate(lines) if cues & set(plain_words(line))]
    good = [(i, i + 1, *judge(lines[i])) for i in has]
    good = [g for g in good if g[2] != "unknown" and g[4]]
    blocks = []
    for i in has:
        a, b = i, i + 1
        while a > 0 and any(c.isalnum() for c in lines[a - 1]):
            a -= 1
        while b < len(lines) and any(c.isalnum() for c in lines[b]):
            b += 1
        if b - a > 1 and (a, b) not in blocks:
            blocks.append((a, b))
    for a, b in blocks:
        whole = "\n".join(re.sub(r"^[^\S\n]*(dnl|rem|c)(?=\s|$)", "", line) if k < b - a - 1 else re.sub(r"^[^\S\n]*(dnl|rem|c)(?=\s)", "", line) for k, line in enumerate(lines[a:b]))
        family, score, sure = judge(whole)
        if family != "unknown" and sure and not any(a <= g[0] < b and g[1] == g[0] + 1 and g[2] == family for g in good if g[1] - g[0] == 1):
            good.append((a, b, family, score, sure))
    top = max(((g[3], -g[0], g[2]) for g in good), default=(None, 0, "unknown"))
    return len(lines), len(has), len(good), ",".join(sorted({g[2] for g in good})), top[2], top[0]


def same_scan(rows, want):
    got = sorted(((r["doc_id"], r["n_paragraphs"], r["n_cued"], r["n_licensed"], r["licences"], r["family"], r["score"]) for r in rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:6] == w[:6] and (g[6] is None) == (w[6] is None) and abs((g[6] or 0) - (w[6] or 0)) < 1e-6, (g, w)


def test_a_text_of_many_notices_takes_linear_time(spark):
    """Blocks are found by their neighbours in one order, not by a search for each cued line."""
    import time

    line = "Permission is granted to use this licence freely"
    took = {}
    for n in (2_000, 2_000, 16_000):  # the first run compiles
        texts = ["\n".join(f"{line} {i}\nand more of it" + "\n" * (i % 3) for i in range(n))]
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(licences._units(F.split(F.lower("t"), "\n"))["blocks"]).alias("n"))
        began = time.perf_counter()
        assert frame.first()["n"] > n // 2
        took[n] = time.perf_counter() - began
    assert took[16_000] < 24 * took[2_000] + 1


def test_a_second_guess_that_a_template_confirms_is_taken(spark):
    model = licences.train(["The weather was fine. It rained."])
    notices = [(c, n) for c, ns in licence_texts.TEMPLATES.items() for n in ns]
    z = np.zeros_like(model.weights)
    misled = licences.LicenceModel(model.classes, z, np.array([2.0 if c == notices[0][0] else 0.0 for c in model.classes]), 0.0, 0.0)
    rows = spark.createDataFrame([(c, n) for c, n in notices], "want string, text string")
    got = licences.scan(rows, misled).select("row.want", F.transform(F.concat("found", "wrapped"), lambda x: F.struct(x["family"], x["confirmed"])).alias("x")).collect()
    sure = {c: [licences.grams_of(licences.words_of(n), 3) for n in ns] for c, ns in licence_texts.TEMPLATES.items()}
    for (want, text), r in zip(notices, sorted(got, key=lambda r: [w for w, _ in notices].index(r["want"])), strict=True):
        assert r["want"] == want and r["x"] and all(found for _, found in r["x"])
    own = {text: {c for c, ts in sure.items() if any(len(t & licences.grams_of(licences.words_of(text), 3)) >= licences.needed(len(t)) for t in ts)} for _, text in notices}
    assert all(family in set().union(*(own[t] for c, t in notices if c == r["want"])) for r in got for family, _ in r["x"])


def test_licence_scan_equals_plain_loops(spark):
    model = licences.train(["The weather was fine. It rained.", "A day by the sea with friends"])
    lines = ["Released under the MIT License.", "nothing here", "ALL RIGHTS RESERVED.", "He lost his license", "Licensed under CC BY-NC 4.0. Contact us", "", "İ Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-or-later"]
    rows = [(i, "\n".join(lines[i:]), "x") for i in range(8)] + [(9, None, "x"), (9, None, "x"), (10, "word " * 40_000 + "mit license", "x"), (None, "\n\n", "x"), (11, "c\nc released under the\nrem MIT license", "x")]
    rows += [(20 + i, f"{a}\n{b}", "x") for i, (a, b) in enumerate(zip(licence_texts.NEAR_MISSES, sum(licence_texts.TEMPLATES.values(), [])))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, found string").withColumn("units", F.lit(1))
    out = licences.scan(docs, model)
    assert python_free(out) and out.select("row.*").columns == docs.columns
    same_scan(out.select(F.col("row.doc_id").alias("doc_id"), *licences.summary(out)).collect(), [(d, *plain_scan(model, t)) for d, t, _ in rows])
    first = out.select(F.col("row.doc_id").alias("doc_id"), *licences.summary(out)).where("doc_id = 0").first()
    assert first["licences"] == "Apache,CC-BY-NC,GPL,MIT,Proprietary" and licences.scan(docs.limit(0), model).count() == 0


def test_licence_query_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = licences.train(licences.background_of(docs))
    same_scan(queries.op6_licences(spark, sf).collect(), [(r["doc_id"], *plain_scan(model, r["text"])) for r in docs.collect()])


# Written for this test alone: none of it is trained on.
LICENSED = [
    ("MIT", "This package is released under the MIT License, see the file LICENSE for details."), ("MIT", "(MIT License) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software')"),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'), ("MIT", "the above copyright notice and this permission notice must be included in all copies or substantial portions of the software"),
    ("BSD", "* Redistributions of source code must retain the above copyright notice, this list of conditions and the disclaimer below."), ("BSD", "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("Apache", "you may not use this file except in compliance with the License. Licensed under the Apache License, Version 2.0"), ("Apache", "# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("GPL", "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF"), ("GPL", "You should have received a copy of the GNU General Public License along with Foo. If not, write to the Free Software Foundation"),
    ("LGPL", "libfoo is licensed under the GNU Lesser General Public License, version 3 or later"), ("AGPL", "Our server is licensed under the GNU Affero General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies"),
    ("MPL", "This file is subject to the terms of the Mozilla Public License, v. 2.0, as are all others."), ("CC-BY", "Photo: this work is licensed under a Creative Commons Attribution 4.0 International License"), ("CC-BY-SA", "Text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC", "Slides licensed under CC BY-NC 4.0, 2021"), ("CC0", "The author has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide"), ("Proprietary", "Copyright 1999 Example Corp. All rights reserved."), ("Proprietary", "Alle Rechte vorbehalten. Nachdruck nur mit Zustimmung."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
UNLICENSED = [
    "The MIT license plate was stolen from the General", "A pilot needs a license for every type of aircraft.", "The public domain of the crown was farmed by tenants.", "Her permission was granted after the dinner.", "Warranty claims rose in the second year.", "The BSD conference distributed badges to all persons.",
    "Two tables were reserved, and all rights turns are closed.", "The Apache people lived in the general region.", "He reads about copyright law and the rights of authors.", "The House of Commons debated licensing hours.", "Driving without a licence is prohibited.", "Confidential talks went on in the city.", "Der Zug fuhr mit Verspätung ab.",
    "The company is liable for damages of the flood.", "Les droits de douane ont augmenté.", "The seller gave a warranty of two years on the machine.",
]


def test_precision_and_recall_on_unseen_paragraphs(spark):
    model = licences.train(licences.background_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    rows = [(i, p, want) for i, (want, p) in enumerate([*LICENSED, *(("", p) for p in UNLICENSED)])]
    out = licences.scan(spark.createDataFrame(rows, "doc_id int, text string, want string"), model)
    got = out.select("row.want", "row.text", *licences.summary(out)).collect()
    right = sum(r["licences"] == r["want"] for r in got if r["want"])
    wrong = [r for r in got if r["licences"] not in ("", r["want"])]
    assert not wrong and right / len(LICENSED) >= 0.85, [(r["want"], r["licences"], r["text"]) for r in got if r["licences"] != r["want"]]
    assert model.calibration_error < 0.1 and all(set(plain_words(n)) & set(licence_texts.CUES) for notices in licence_texts.TEMPLATES.values() for n in notices)


def test_training_is_repeatable_and_folds_keep_variants_together():
    background = ["So it was and so it is, they said, over and over again", "The press copyright was debated"] * 3
    rows = licences.training_rows(background)
    of = collections.defaultdict(set)
    for p, c, source in rows:
        of[source].add(c)
    assert all(len(c) == 1 for c in of.values()) and len(of) > 250
    a, b = licences.train(background), licences.train(background)
    assert (a.weights == b.weights).all() and (a.bias == b.bias).all() and 0 <= a.calibration_error <= 1
    assert licences.calibration_error(np.array([[0.9, 0.1], [0.9, 0.1]]), np.array([0, 1])) == pytest.approx(0.4)


WRAPPED = {
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL": "This library is free software; you can\nredistribute it and/or modify it under\nthe terms of the GNU Lesser General\nPublic License as published by the Free\nSoftware Foundation.",
    "MIT": "Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated\ndocumentation files, to deal in the\nSoftware without restriction.",
    "BSD": "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided\nthat the following conditions\nare met:",
}


def test_wrapped_notices_are_found(spark):
    model = licences.train(["The weather was fine. It rained.", "A day by the sea with friends"])
    marks = {"plain": ("", "", ""), "hash": ("#\n", "# ", "\n#"), "block": ("/*\n", " * ", "\n */"), "slashes": ("//\n", "// ", "\n//"), "m4": ("dnl\n", "dnl ", "\ndnl")}
    rows = [(f, m, head + "\n".join(mark + line for line in notice.split("\n")) + tail + "\n\nx = 1\ny = 2") for f, notice in WRAPPED.items() for m, (head, mark, tail) in marks.items()]
    both = WRAPPED["GPL"] + "\n *\n" + WRAPPED["MIT"] + "\n\nReleased under the MIT License."
    rows += [("GPL,MIT", "two", both), ("", "prose", "The driver showed a license\nto the officer of the\npublic library."), ("", "null", None), ("", "empty", "\n\n\n")]
    out = licences.scan(spark.createDataFrame(rows, "want string, mark string, text string"), model)
    assert python_free(out)
    got = out.select("row.want", "row.mark", *licences.summary(out)).collect()
    assert len(got) == len(rows) and all(r["licences"] == r["want"] for r in got), got
    assert {r["n_licensed"] for r in got if "," not in r["want"] and r["want"]} == {1} and next(r["n_licensed"] for r in got if r["mark"] == "two") == 3


def test_unknown_is_trained_on_prose_with_cue_words(spark):
    prose = ["The general public reads the licensed version of the source", "Rights and permission were in the charge of the author"]
    far = "so it was and\n" * 1_000 + "\n" + prose[1]
    texts = [prose[0] + "\nand more of it", far, WRAPPED["GPL"], "Released under the MIT License.\nThe end"]
    background = licences.background_of(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    unknown = {p for p, c, _ in licences.training_rows(background) if c == licences.UNKNOWN}
    lower = lambda p: p.translate(licences._LOWER)
    assert {lower(prose[0]), lower(prose[0]) + "\nand more of it", lower(prose[1])} <= unknown
    assert not unknown & {lower(WRAPPED["GPL"]), lower("Released under the MIT License.")}
    assert {c for p, c, _ in licences.training_rows(["Released under the MIT License.", *prose]) if p in prose} == {licences.UNKNOWN}
    # Held-out prose of the corpus, in other words than the near misses, is unknown with a higher probability than without it.
    corpus = [f"{a} licensed version of the {b} was in the public charge of the city" for a in ("a", "one", "this", "that", "each") for b in ("road", "bridge", "market", "school", "river", "park")]
    held = "her licensed version of the story was in the public charge of the city"
    with_prose, without = plain_unknown(licences.train(corpus), held), plain_unknown(licences.train(["so it was"]), held)
    assert with_prose > without


def plain_unknown(model, paragraph):
    """The probability of unknown."""
    w = plain_words(paragraph)
    z = model.bias + sum(model.weights[zlib.crc32(g.encode()) % len(model.weights)] for g in {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})
    return float(np.exp(z[-1]) / np.exp(z).sum())
