"""The ten operators on small fixtures: brute force, round trips, held-out accuracy and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kham.llm import ann, jaccard_join, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, token_counts, url_filters, vectors
from kham.llm.common import Workspace, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, held_out int"
WORDS = "the of and house river stone light water green paper north after under small large time day night road field".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Near and exact copies, null, empty, short and long texts, repeated rows and ids, columns with clashing names."""
    rng = random.Random(1)
    rows = [(i, text(rng, rng.choice([1, 2, 3, 5, 30, 80])), rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None])) for i in range(60)]
    base = text(rng, 60).split()
    for i in range(60, 90):  # near copies of one text
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = "x" + str(rng.randint(0, 9))
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, " \n\t ", "en", "s1"), (93, text(rng, 5000), "fr", "s2"), (94, "A b", "en", "s0"), (95, "a B", "en", "s0"),
             (96, "x" * 5000, "en", "s1"), (97, "1234 !!", "fr", "s1"), (97, "1234 !!", "fr", "s1"), (None, "a null id", "en", "s1")]
    return spark.createDataFrame([(*r, 1, "clash", 7) for r in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(i, folds):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == 1


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 3, size=(900, 1))
    x[50] = x[51]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0]), (None, [1.0] * 12), (0, [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = {}
    for r in ann.nearest_neighbours(df, F.col("id") % 20 == 0, leaves=32).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, g in got.items():
        g.sort()
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        assert [r for r, _, _ in g] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in g)
        assert [(-v, i) for _, i, v in g] == sorted((-v, i) for _, i, v in g)
        hit += len({i for _, i, _ in g} & set(want.tolist()))
    assert hit / (20 * len(got)) >= 0.9
    few = df.where("vec_id < 5")
    assert ann.nearest_neighbours(few, F.col("id") % 20 == 0).count() == 4
    assert ann.nearest_neighbours(df.where("vec_id = -1"), F.col("id") % 20 == 0).count() == 0


def test_near_dedup(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x[100:180] = x[100] + rng.normal(size=(80, 16)) * 0.02
    for i in range(0, 40, 2):
        x[i + 1] = 3 * x[i] + rng.normal(size=16) * 0.05
    x = np.vstack([x, np.repeat(x[200:201], 700, 0), x[201] + rng.normal(size=(700, 16)) * 0.01])  # larger than a block of a leaf
    at = [*range(400), *range(1000, 2400)]
    rows = [(i, [float(v) for v in r]) for i, r in zip(at, x)] + [(500, None), (501, [0.0] * 16), (502, [float("inf")] * 16)]
    got = {r["vec_id"]: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=32).collect()}
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = v @ v.T >= 0.9
    np.fill_diagonal(s, False)
    lab = np.array(at)
    for _ in range(400):
        new = np.minimum(lab, np.where(s, lab[None], 9999).min(1))
        if (new == lab).all():
            break
        lab = new
    wrong = [i for k, i in enumerate(at) if (got[i]["n_links"], got[i]["component_id"]) != (int(s[k].sum()), int(lab[k]))]
    assert len(wrong) <= 4 and len(got) == 1803
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (500, 501, 502))


def linked(x, threshold=0.9):
    """(links of each row, least row of its component) by comparing all."""
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = v @ v.T >= threshold
    np.fill_diagonal(s, False)
    lab = np.arange(len(x))
    while (new := np.minimum(lab, np.where(s, lab[None], len(x)).min(1))).tolist() != lab.tolist():
        lab = new
    return s.sum(1).tolist(), lab.tolist()


def near_dedup_rows(spark, x, **how):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(near_dedup.near_duplicates(df, **how).collect(), key=lambda r: r["vec_id"])
    return ([r["n_links"] for r in got], [r["component_id"] for r in got]), got


def test_near_dedup_links_dense_groups(spark):
    """Two groups of 200 whose members have more nearer neighbours in their own group than any list holds."""
    rng = np.random.default_rng(5)
    centre = np.eye(64)[:2].repeat(200, 0)
    centre[200:, 0] = math.cos(math.radians(20))
    centre[200:, 1] = math.sin(math.radians(20))
    centre[:200, 1] = 0
    x = np.concatenate([centre + rng.normal(0, 0.012, (400, 64)), rng.normal(0, 1, (60, 64))])
    want = linked(x)
    assert max(want[1][:400]) == 0 and sum(want[0]) > 2 * 200 * 199
    assert near_dedup_rows(spark, x)[0] == want


def test_near_dedup_compares_all_below_target(spark, monkeypatch):
    """One poor graph: pairs apart from a large group, which must not hide them, are found by comparing all rows."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    rng = np.random.default_rng(6)
    one = rng.normal(0, 1, (150, 16))
    x = np.concatenate([one, one + rng.normal(0, 0.17, one.shape), rng.normal(0, 1, 16) + rng.normal(0, 0.05, (60, 16))])
    want = linked(x)
    got, rows = near_dedup_rows(spark, x, rounds=0, broadcast_bytes=8000)
    assert got == want and {r["audit_recall"] for r in rows} == {1.0}
    assert near_dedup.still_missed(0.45**2, 3) == pytest.approx(0.45**3) and near_dedup.still_missed(0.1, 2) == pytest.approx(0.01)


def brute_ctw(train, test, depth=lm_scoring.DEPTH):
    nodes = {}
    form = lambda t: [lm_scoring.PAD] * depth + [c + 32 if 65 <= c <= 90 else c for c in t] + [lm_scoring.END]
    for b in map(form, train):
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                for k in range(8):
                    nodes.setdefault((tuple(b[i - d : i]), (b[i] | 256) >> (8 - k)), [0, 0])[(b[i] >> (7 - k)) & 1] += 1
    kids = {}
    for c, p in nodes:
        if c:
            kids.setdefault((c[1:], p), []).append((c, p))
    memo = {}

    def weight(k):
        if k not in memo:
            a, b = nodes[k]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            below = None if len(k[0]) == depth else sum(weight(x)[0] for x in kids[k])
            memo[k] = (own, 1.0) if below is None else (np.logaddexp(own, below) - math.log(2), 1 / (1 + math.exp(min(700, below - own))))
        return memo[k]

    def q(ctx, p, d):
        k = (tuple(ctx[len(ctx) - d :]), p)
        if k not in nodes:
            return 0.5
        p1 = (nodes[k][1] + 0.5) / (sum(nodes[k]) + 1)
        w = weight(k)[1]
        return p1 if d == depth else w * p1 + (1 - w) * q(ctx, p, d + 1)

    out = []
    for b in map(form, test):
        s = 0.0
        for i in range(depth, len(b)):
            for k in range(8):
                x = q(b[i - depth : i], (b[i] | 256) >> (8 - k), 0)
                s += math.log10(x if (b[i] >> (7 - k)) & 1 else 1 - x)
        out.append(s)
    return out


def test_lm_scores(spark, docs):
    small = docs.where("doc_id is null or doc_id < 12 or doc_id between 88 and 92 or doc_id >= 94")
    rows = [(r["doc_id"], (r["text"] or "")) for r in small.collect()]
    train = [t for i, t in rows if not held(i, 5)]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = lambda t: __import__("re").findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None]
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    base = {(i, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)).__round__(6)) for i, t in rows}
    scores = {(i, round(s, 6)) for (i, t), s in zip(rows, brute_ctw([t.encode() for t in train], [t.encode() for _, t in rows]))}
    for limit in (10**6, 10):  # broadcast and joined
        got = lm_scoring.lm_scores(small, broadcast_rows=limit).collect()
        assert {(r["doc_id"], round(r["base_score"], 6)) for r in got} == base
        assert {(r["doc_id"], round(r["score"], 6)) for r in got} == scores
        assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"], 5) for r in got) and len(got) == len(rows)
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


def test_language_id(spark):
    rng = random.Random(2)
    parts = {"aa": "tha ing er on", "bb": "eau tion qui le", "cc": "sch ein ung der", "dd": "ción os que as"}
    rows = []
    for i in range(600):
        k = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), k))
    rows += [(600, None, "aa"), (601, "123 ++", "bb"), (602, "", None), (603, "漢字", None), (603, "漢字", None), (None, "tha ing", None)]
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))).collect()
    truth = {i: k for i, _, k in rows[:600]}
    out = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (600, 601, 602)) and by[603]["lang_pred"] in parts
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.language_id(empty(spark)).count() == 0


def brute_components(rows, width, t):
    sets = []
    for i, x in rows:
        w = __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    lab = list(range(len(rows)))

    def root(a):
        while lab[a] != a:
            a = lab[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                lab[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted((str(i), len(sets[a]), str(least.get(root(a)) if sets[a] else i)) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("width,t,chunk", [(4, 85, 4000), (4, 85, 3), (5, 80, 4000), (2, 60, 4)])
def test_jaccard(spark, docs, width, t, chunk):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs, width=width, threshold=t, chunk=chunk, broadcast_rows=10 if chunk == 3 else 10**6).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, width, t)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_divide_skip_against_brute_force():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 40))) for _ in range(150)]
    sets += [sorted(set(s) - {s[0]}) or s for s in sets[:50]]
    index = jaccard_join.Index()
    for i, s in enumerate(sets):
        index.add(i, s)
    for t in (50, 80, 85):
        for i, s in enumerate(sets):
            want = {j for j, o in enumerate(sets) if 100 * len(set(s) & set(o)) >= t * len(set(s) | set(o))}
            assert set(index.search(s, [len(o) for o in sets], t)) == want


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 60), (60, 70), (5, 5)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in components(Workspace(spark, "t"), e).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (50, 60, 70)} == {50}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=256, tiers=(64, 128), buffer=16).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    total = Counter()
    seqs = {}
    for p in pieces:
        x = np.array(ids[p["doc_id"]][0], "<u4")
        assert zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and len(x) == p["doc_tokens"]
        total[p["doc_id"]] += p["length"]
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert total == {i: sum(map(len, x)) for i, x in ids.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty(spark), path).count() == 0


def test_mixing(spark, docs):
    w = {"domain": {"d0": 2}, "lang": {"en": 3}, "source": {}}
    got = mixing.mix_sources(docs, mixing.source_domain(F.col("source")), w, budget=F.expr("total div 2"), max_epochs=2).collect()
    total = sum(len((r["text"] or "").split()) for r in docs.collect())
    taken = sum(r["taken_tokens"] for r in got)
    assert total // 2 - 20 <= taken <= total // 2
    assert all(0 < r["taken_tokens"] <= 2 * r["n_tokens"] for r in got)
    assert mixing.mix_sources(empty(spark), F.lit("a"), {}).count() == 0


def test_water_filling(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 20), ("b", "x", "s4", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["share"] for r in mixing.leaf_budgets(leaves, F.lit(800), {}, 1).collect()}
    # a and b get 400 each; y holds 20, so x gets 380: s1 holds 10, its sibling takes the rest
    assert got == {"s1": 10, "s2": 370, "s3": 20, "s4": 400}


def test_url_filters(spark):
    rng = random.Random(6)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "/", "block"), ("net", "/es/x", "allow"), ("ample.com", "/", "block")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com", "http://example.com/en/?q#f", "https://www.example.com/en/1://x", "http://x.net?/es/", "http://com/", "http://example.com./en/", "http://a..net/es/"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.', 'm.'])}{rng.choice(['example.com', 'b.net', 'net', 'org', 'Sample.com'])}{rng.choice(['', '/', '/en/', '/es/x', '/es/', '/fr'])}{rng.choice(['', '?a', '#b', 'c'])}" for _ in range(300)]
    df = spark.createDataFrame([(i % 290, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit("h"))
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    want = []
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            m = __import__("re").match(r"([^/?#]*)([^?#]*)", rest)
            host, path = m[1].lower(), m[2]
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        want.append((i % 290, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    for block in (100, 2):
        got = url_filters.url_filters(df, table, rule_block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filters.url_filters(df.where("page_id < 0"), table).count() == 0


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = ["a  b", "x\n\ny z", " lead", "trail ", "it's don't '  'll x", "<|endoftext|> a<|endoftext|>b", "漢字 かな 123 45", "\t tab\r\n x", "🙂 😀😀 a", "a\x1cb c", "word " * 400, "q" * 3000, ". , ; " * 200]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for window, overlap in ((1 << 16, 1024), (120, 16)):
        for r in token_counts.token_counts(df, path, window=window, overlap=overlap, limit=50).join(df, "doc_id").collect():
            t = r["text"] or ""
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 50), t[:60]
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_windows_that_do_not_align_are_widened():
    """Encodings that disagree at first, and texts without stable boundaries, still give the library's count."""
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        e = token_counts.encoder(public_tokenizers.path(name))
        rng = random.Random(12)
        long = text(rng, 3000)
        whole = len(e.offsets(long))
        n, windows, widened = token_counts.splice_count(long, e.offsets, 1000, 40)
        assert n == whole and windows > 20
        asked = []

        def shifty(part):  # the first windows lose a token in their first half
            asked.append(part)
            got = e.offsets(part)
            return got[:3] + got[4:] if len(asked) in (2, 3) else got

        n, _, widened = token_counts.splice_count(long, shifty, 1000, 40)
        assert abs(n - whole) <= 1
    e = token_counts.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    bare = "".join(rng.choice("abcdefgh漢é") for _ in range(3000)) + " " + text(rng, 300)
    n, _, widened = token_counts.splice_count(bare, e.offsets, 200, 32)
    assert n == len(e.offsets(bare)) and widened > 3


def test_license_scan(spark):
    files = [(1, "r/LICENSE", "Released under the MIT License.\nmore words here"), (2, "r/a/x.py", "nothing"), (3, "r/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
             (4, "r/a/b/c/y.py", "nothing"), (5, "r/a/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (6, "q/w.py", None), (7, None, "Licensed under CC BY-NC 4.0."), (8, None, "x"), (8, None, "x"),
             (9, "q/long", ("word " * 300) + "Licensed under CC BY-NC 4.0. " + "word " * 300)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in license_scan.license_scan(df, F.col("path"), threshold=0.5).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == (None, "MIT", "r") and got[4] == (None, "GPL-3.0", "r/a/b") and got[5] == ("Apache-2.0", "Apache-2.0", None)
    assert got[6] == (None, None, None) and got[7][0] == "CC-BY-NC-4.0" and got[8] == (None, None, None)
    assert license_scan.license_scan(df.where("doc_id < 0"), F.col("path")).count() == 0


APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS"""


@pytest.mark.parametrize("notice,licence", [
    ("Copyright (c) 2020 Foo Inc. Released under the MIT License. See LICENSE for details.", "MIT"),
    ("# Copyright 2020 The Foo Authors. SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    (APACHE, "Apache-2.0"), (APACHE.replace("\n", " "), "Apache-2.0"),
    ("it under the terms of the GNU General Public License as published by", "GPL"),
    ("it under the terms of the GNU General Public\n# License as published by the Free Software Foundation; either version 2 of\n# the License, or (at your option) any later version.", "GPL-2.0"),
    ("it under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation, either version 3 of the License", "LGPL-3.0"),
    ("All texts and pictures of this site are licensed under\nCC BY-NC 4.0. Write to the editors for other uses.", "CC-BY-NC-4.0"),
])
def test_license_notices_among_other_words(notice, licence):
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.6)
    rng = random.Random(9)
    for text_ in (notice, text(rng, 40) + " " + notice + " " + text(rng, 40), text(rng, 300) + "\n" + notice + "\n" + text(rng, 300)):
        assert s.scan(text_)[0] == licence
    two = s.scan(notice + " " + text(rng, 90) + " Licensed under the Mozilla Public License, version 2.0. " + text(rng, 90))
    assert two[2] == sorted([licence, "MPL-2.0"])
    for free in ("He studied at MIT and got a licence to drive.", "Version 2.0 of the work is free for any person, see the terms and conditions.", "sich erst mit mit der\nMit stein.", text(rng, 400)):
        assert s.scan(free) == (None, 0.0, [])


def test_every_license_template_is_found_in_a_long_line():
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.6)
    rng = random.Random(10)
    for name, forms in license_scan.TEMPLATES.items():
        for form in forms:
            got = s.scan(text(rng, 100) + " " + form.replace("\n", " ") + " " + text(rng, 100))
            assert got[0] == name and got[1] > 0.999


def test_anchors_lose_nothing():
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.6)
    rng = random.Random(8)
    words = sorted(s.idf)
    for _ in range(4000):
        unit = [rng.choice(words + WORDS) for _ in range(rng.randint(1, 14))]
        if s.cosine(unit):
            assert s.anchors.intersection(unit)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = P.language_stage(spark, rows, "")
    assert kept.columns == list(P.COLUMNS)
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {90, 91, 92, 97}
    one = P.near_duplicate_stage(spark, rows, "")
    got = [(r["doc_id"], r["text"]) for r in one.collect()]
    comp = {(i, c) for i, n, c in brute_components([(r["doc_id"], r["text"]) for r in rows.collect()], 5, 80)}
    assert {str(i) for i, _ in got if i is not None} == {i for i, c in comp if i == c and i != "None"} and len(got) == len(set(got))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0


def test_lm_many_words_few_grams(spark, monkeypatch):
    """More words than a broadcast table holds: grams are still looked up, with the results of both lookups."""
    letters = "abcd"
    words = [a + b + c + d + e for a in letters for b in letters for c in letters for d in letters for e in letters]
    docs = spark.createDataFrame([(i, " ".join(words[i * 16 : i * 16 + 16] * 2)) for i in range(64)] + [(64, None), (65, "")], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "regexp_replace(text, '([abcd])', '$1$1$1$1$1$1$1$1') AS text")  # 1025 words, fewer grams a word
    counted, joined = [], lm_scoring._joined
    monkeypatch.setattr(lm_scoring, "_joined", lambda *a: counted.append(a[3]) or joined(*a))
    key = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6), r["n_bytes"])
    want = sorted(map(key, lm_scoring.lm_scores(docs).collect()))
    got = sorted(map(key, lm_scoring.lm_scores(docs, broadcast_rows=1000).collect()))
    assert got == want and counted == [False]


def test_ann_cells_pass_queries_by_batches():
    """However many queries a cell has, they come batch by batch beside its candidates."""
    import pyarrow as pa

    def batch(rows):
        leaf, block, q, i, x = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(block, pa.int32()), pa.array(q), pa.array(i, pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["leaf", "block", "q", "id", "x"])

    v = [1.0, 2.0]
    got = list(ann._cells(iter([batch([(1, 0, False, 5, v), (1, 0, False, 5, v)]), batch([(1, 0, False, 6, v), (1, 0, True, 7, v)]), batch([(1, 0, True, 8, v), (2, 0, True, 8, v)]), batch([(3, 0, False, 9, v), (3, 0, True, 9, v)])]), 2))
    assert [(c.tolist(), q.tolist()) for c, _, q, _ in got] == [([5, 6], [7]), ([5, 6], [8]), ([9], [9])]


def test_ann_queries_go_once_to_a_part(spark):
    """A task doesn't copy a query for each leaf that it visits."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("id") % 3 == 0)
    assert len(got.collect()) == 20_000
    plan = got._jdf.queryExecution().executedPlan()
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            seen.append(node.metrics().apply("shuffleRecordsWritten").value())
    assert max(seen) == 3000 + 1000  # one part


def test_tree_order_is_best_first():
    rng = np.random.default_rng(9)
    for n, d in ((400, 3), (400, 20), (3, 2)):
        tree = vectors.Tree(rng.normal(size=(n, d)), 5)
        q = rng.normal(size=(40, d))
        assert tree.order(q).tolist() == [list(tree.best_first(v)) for v in q]
    assert tree.order(q[:0]).shape == (0, tree.leaves)


def test_ann_part_is_exact_in_its_leaves():
    """Copies, ties, norms of all sizes and repeated rows: as all products in double precision."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 6))
    x[100:200] = x[:100]
    x[200:260] = x[0]
    x[260:330] = np.round(x[260:330])
    x[330:400] *= 1e-7
    x[400] *= 1e9
    x[401:500] = x[401] * (1 + 1e-9 * rng.normal(size=(99, 1)))
    ids, leaf = rng.permutation(700) * 3, rng.integers(0, 9, 700)
    leaf[200:260] = 4
    leaves = np.array([1, 2, 4, 5, 7, 8])
    for dtype in (np.float64, np.float32):
        v = x.astype(dtype)
        part = ann.Part(np.append(ids, ids[:50]), np.vstack([v, v[:50]]), np.append(leaf, leaf[:50]), leaves, 7)
        q, qid = v[::4].astype(np.float64), ids[::4]
        visited = rng.random((len(q), len(leaves))) < 0.6
        visited[0], visited[1] = True, False
        r, i, s = part.search(qid, q, visited)
        for n in range(len(q)):
            at = np.flatnonzero(np.isin(leaf, leaves[visited[n]]) & (ids != qid[n]))
            e = np.einsum("ij,ij->i", np.repeat(q[n : n + 1], len(at), 0), v[at].astype(np.float64))
            best = np.lexsort((ids[at], -e))[:7]
            assert i[r == n].tolist() == ids[at][best].tolist() and s[r == n].tolist() == e[best].tolist()


def test_ann_parts_hold_all_leaves():
    got = [(p.tolist(), n) for p, n in ann.parts_of(np.array([3, 0, 4, 25, 2, 10, 1]), 10)]
    assert got == [([0, 2], 1), ([3], 3), ([4], 1), ([5], 1), ([6], 1)]
