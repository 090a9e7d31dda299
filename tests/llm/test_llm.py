"""The training-data operators against brute force, round trips and held-out scores, and on awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from proofloom.llm import components, licenses, mixing, outliers, rollups, simhash, suffix_tree, tokenfile
from proofloom.llm.common import scratch, tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, block int, fp string"
GAP = re.compile(r"[\x20\x09-\x0D]+")


def docs_frame(spark, texts, lang="en", source="s"):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None, "r", 1, "x") for i, t in texts], DOCS)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a b"), (5, "a b"), (None, "c d e f"), (6, "\x00 é 中   <|endoftext|>"), (7, "word " * 30000), (8, "x" * 50000)]


def split(t):
    return [w for w in GAP.split(t or "") if w]


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sample_texts(data, n=200):
    import duckdb

    return duckdb.connect().sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()


# --- op1


def slow_fingerprint(t, width=3):
    w = split(low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    values = sorted({f for _, f in fps})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    first = {}
    for d, f in fps:
        if d is not None:
            first[find(f)] = min(first.get(find(f), d), d)
    return Counter((d, f, first.get(find(f))) for d, f in fps)


def test_simhash_classes(spark, data):
    rows = sample_texts(data) + [(1000 + i, t) for i, t in AWKWARD if i] + [(None, "c d e f")]
    out = simhash.classes(docs_frame(spark, rows)).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
    assert Counter((r.doc_id, int(r.h, 16), r.component_id) for r in out) == slow_classes(rows)


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_covering_masks_cover(radius):
    rnd = random.Random(radius)
    masks = simhash.covering_masks(radius)
    assert len(masks) == (2 << radius) - 1
    for _ in range(2000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, radius)))
        assert any(diff & m == 0 for m in masks)


def test_oversized_buckets_lose_no_link(spark):
    """Thousands of fingerprints around a few centres, in buckets far beyond their limit."""
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 6))) for c in centres for _ in range(500)}
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = components.components(simhash.links(frame, 3, bucket_rows=16)).collect()
    root = {f: f for f in fps}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and find(a) != find(b):
                root[find(b)] = find(a)
    want = {}
    for f in fs:
        want.setdefault(find(f), set()).add(simhash._signed(f))
    have = {}
    for r in got:
        have.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, have.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert all(root == min(g) for root, g in have.items())


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(e.orderBy(F.rand(2))).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components.components(e.limit(0)).count() == 0


# --- op2


def test_license_base(spark):
    rows = [(1, "Released under the MIT License. mit  license"), (2, "MIT/License; General-Public:License"), (3, "smit license licenses"), *[(10 + i, t) for i, (_, t) in enumerate(AWKWARD)], (30, "mit licensé"), (31, "the Apache License, Version 2.0")]
    out = {r.doc_id: r for r in licenses.scanned(docs_frame(spark, rows)).collect()}
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(i, k) for p, k in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = out[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({k for _, k in at}))), t
        assert (r.first_word, r.last_word) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert out[31].labels == "apache,apache-2.0" and out[1].labels == "mit"


def test_licenses_of_nothing(spark):
    none = licenses.scanned(docs_frame(spark, []))
    assert none.count() == 0 and {"doc_id", "n_words", "n_base", "labels", "score"} <= set(none.columns)
    twice = licenses.scanned(docs_frame(spark, [(None, None), (1, "MIT License"), (1, "MIT License")])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.base_labels) for r in twice) == [(0, 0, ""), (1, 2, "mit"), (1, 2, "mit")]


def test_license_names_without_their_optional_tails():
    label = lambda t: licenses.scan(t.encode())["labels"]
    assert "gpl-2.0-classpath" in label("GPL v2 with the Classpath Exception.") and "gpl-2.0-classpath" in label("Classpath Exception to the GPL applies")
    assert "lgpl-2.0" in label("GNU Library General Public License") and "lgpl-2.0" in label("GNU Library General Public License version 2 or so")


def test_license_suppression():
    label = lambda t: licenses.scan(t.encode())["labels"]
    assert label("Licensed under CC BY-NC 4.0") == "cc-by-nc-4.0"
    assert label("GNU Lesser General Public License v2.1") == "gpl,lgpl-2.1"
    assert label("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert label("nothing here") == ""
    rules = licenses.rules()
    assert len(rules) > 200
    scanner, rnd = licenses._scanner(), random.Random(2)
    vocab = "licensed under the apache license version 2 0 gnu lesser general public v2 1 mit cc by nc sa 4 0 all rights reserved bsd 3 clause gpl".split()
    for _ in range(500):
        line = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30)))
        found = [(m.start(), m.end(), k) for k, (_, _, words, rx) in enumerate(scanner.rules) if all(w in line for w in words) for m in rx.finditer(line)]
        kept = []
        for x in sorted(found, key=lambda x: (-scanner.rules[x[2]][1], x[0] - x[1], x[2], x[0])):
            if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
                kept.append(x)
        assert scanner.detections(line) == sorted(kept)


# --- op3


def test_token_files(spark, data):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_file())
    rows = sample_texts(data, 60) + [(1000 + (i or 0), t) for i, t in AWKWARD]
    rnd = random.Random(3)
    rnd.shuffle(rows)
    path = tokenfile.written(docs_frame(spark, rows + [(None, "no id")]).repartition(3), tokenizer_file())
    out = tokenfile.digests(spark, path).collect()
    want = Counter()
    for d, t in [*rows, (None, "no id")]:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    some = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_documents(spark, path, [3, 7]).collect()}
    assert some == {d: tk.encode(t, add_special_tokens=False).ids + [2] for d, t in rows if d in (3, 7)}


def test_token_files_split_an_id_of_many_rows(spark, monkeypatch):
    """Buckets of ten rows; one id and null have most of the rows. Order and starts hold."""
    monkeypatch.setattr(tokenfile, "BUCKET_DOCS", 10)
    rnd = random.Random(31)
    rows = [(rnd.choice([None, 7, 7, i]), f"text {i} " * rnd.randint(0, 5)) for i in range(400)]
    path = tokenfile.written(docs_frame(spark, rows).repartition(3), tokenizer_file())
    out = sorted(tokenfile.digests(spark, path).collect(), key=lambda r: r.start)
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows)
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out[:-1]]]).tolist()
    shards = spark.read.parquet(f"{path}/shards").select("bucket", "first_doc", "last_doc").collect()
    assert sum(r.first_doc == r.last_doc == 7 for r in shards) > 3 and sum(r.last_doc is None for r in shards) > 3


def test_token_files_of_nothing(spark):
    path = tokenfile.written(docs_frame(spark, []), tokenizer_file())
    assert tokenfile.digests(spark, path).collect() == []


def test_shards_know_their_dictionary():
    blob = tokenfile.pack([1], [1], [b"x"], 2, hashlib.sha256(b"a").digest())
    with pytest.raises(ValueError):
        tokenfile.Shard(blob, b"b")


def test_encoder_cuts_are_exact():
    from tokenizers import Tokenizer

    tk, enc, rnd = Tokenizer.from_file(tokenizer_file()), tokenfile.Encoder(tokenizer_file()), random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "'", "!", "...", " ", "᠎", "\x1c", "\x85", "<|endoftext|>", "中", "́", "😀", " x", "​", "﻿", "\x00", "\xa0", "Ġ", "word,", " foo."]
    batch = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(5000)]
    for t, raw in zip(batch, enc(batch)):
        assert np.frombuffer(raw, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


# --- op6


def test_mixing_targets(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(0, 40), "en", s, None, "r", 1, "x") for i, s in enumerate(["a"] * 600 + ["b"] * 150 + ["c"] * 60 + [None] * 40)]
    d = spark.createDataFrame(rows, DOCS)
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    used = mixing.mixed(d, max_repeats=3.0).select("row.doc_id", "row.source", "epoch", "n_tokens", "weight").collect()
    spent = Counter()
    for r in used:
        spent[r.source] += r.n_tokens
    passes = {s: spent[s] / size[s] for s in size}
    assert passes["a"] == pytest.approx(1, abs=0.05) and max(passes.values()) == pytest.approx(3, abs=0.1)
    assert {r.doc_id for r in used} == set(range(len(rows)))  # nothing is dropped
    assert max(Counter((r.doc_id, r.epoch) for r in used).values()) == 1
    goal = 0.6 * math.log(4) + 0.4 * -sum(n / sum(size.values()) * math.log(n / sum(size.values())) for n in size.values())
    used = mixing.mixed(d, entropy=goal, budget=2000.0).select("row.source", "n_tokens", "weight").collect()
    w = {r.source: r.weight for r in used}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(goal, abs=1e-6)
    assert sum(r.n_tokens for r in used) == pytest.approx(2000, abs=4 * 40)
    assert mixing.mixed(d.limit(0), max_repeats=2.0).count() == 0
    # equal rows are used alike, and a source of one id is cut between its texts
    one = docs_frame(spark, [(1, f"{i % 200} w w") for i in range(400)])
    kept = Counter(r.text for r in mixing.mixed(one, max_repeats=2.0).select("row.text").collect())
    assert set(kept.values()) == {2}
    part = Counter(r.text for r in mixing.mixed(one, entropy=0.0, budget=600.0).select("row.text").collect())
    assert set(part.values()) == {2} and sum(part.values()) * 3 == pytest.approx(600, abs=6)
    plain = mixing.mixed(docs_frame(spark, AWKWARD), max_repeats=2.0)
    assert plain.count() == len(AWKWARD)


# --- op7


def slow_base(rows):
    c, n = Counter(), 0
    toks = [(d, [*split(low(t)), None]) for d, t in rows]
    for d, w in toks:
        if not suffix_tree.held_out(d):
            c.update(w)
            n += len(w)
    return Counter((d, suffix_tree.held_out(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w), 6)) for d, w in toks)


@pytest.fixture(scope="module")
def scored(spark, data):
    rows = sample_texts(data) + [(None if i is None else 1000 + i, t) for i, t in AWKWARD]
    return rows, suffix_tree.scores(docs_frame(spark, rows).repartition(3)).collect()


def test_base_scores(scored):
    rows, out = scored
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == slow_base(rows)


def slow_tree(rows, depth, min_gain):
    """The same model by dictionaries over all contexts."""
    line = lambda t: " ".join([*split(low(t)), "\n"]).encode()
    count = {}
    for d, t in rows:
        if not suffix_tree.held_out(d):
            s = b"\n" * depth + line(t)
            for i in range(depth, len(s)):
                for k in range(depth + 1):
                    count.setdefault(s[i - k : i], Counter())[s[i]] += 1
    total = {c: sum(x.values()) for c, x in count.items()}

    def mixed(ctx, y, keep):
        if not ctx:
            return (count.get(b"", {}).get(y, 0) + 1) / (total.get(b"", 0) + 256)
        p = mixed(ctx[1:], y, keep)
        if ctx not in count or (keep is not None and len(ctx) > 2 and ctx not in keep):
            return p
        x = count[ctx]
        return (x.get(y, 0) + len(x) * p) / (total[ctx] + len(x))

    keep = set()
    for ctx, x in count.items():
        if len(ctx) > 1 and sum(n * math.log(n / total[ctx] / mixed(ctx[1:], y, None)) for y, n in x.items()) >= min_gain:
            keep.update(ctx[k:] for k in range(len(ctx) - 1))
    c = Counter()
    for d, t in rows:
        if not suffix_tree.held_out(d):
            c.update([*split(low(t)), None])
    n, own = sum(c.values()), suffix_tree.OWN
    out = []
    for d, t in rows:
        s, at, total_log = b"\n" * depth + line(t), depth, 0.0
        for w in [*split(low(t)), None]:
            spelt = 1.0
            for _ in range(1 if w is None else len(w.encode()) + 1):
                spelt *= mixed(s[at - depth : at], s[at], keep)
                at += 1
            total_log += math.log10(own * c[w] / n + (1 - own) * spelt)
        out.append(total_log)
    return out


@pytest.mark.parametrize("pairs", [1, 256, 1 << 20])
def test_tree_scores_against_dictionaries(spark, data, monkeypatch, pairs):
    """No pair of bytes is split by the third, some are, all are; the last also over more tasks than the session's."""
    monkeypatch.setattr(suffix_tree, "PAIRS", pairs)
    if pairs > 256:
        for name, value in (("BLOCK", 1000), ("TASK_BLOCKS", 1), ("TASK_GRAMS", 100)):
            monkeypatch.setattr(suffix_tree, name, value)
    rows = [(d, (t or "")[:400]) for d, t in sample_texts(data, 40)] + [(500, ""), (501, None)]
    out = {r.doc_id: r.score for r in suffix_tree.scores(docs_frame(spark, rows).repartition(2)).collect()}
    for (d, _), want in zip(rows, slow_tree(rows, suffix_tree.DEPTH, 4.0)):
        assert out[d] == pytest.approx(want, rel=1e-6)


def test_held_out_texts_score_above_the_base(spark):
    """Over texts enough for the tree; base scores give each unseen word the same, which on little training is more than any distribution could."""
    rows = sample_texts("/root/testdata/sf0.1", 10000)
    own = [r for r in suffix_tree.scores(docs_frame(spark, rows)).collect() if r.held_out]
    assert len(own) > 1000 and sum(r.score for r in own) > 0.98 * sum(r.base_score for r in own)


def test_scores_of_nothing(spark):
    assert suffix_tree.scores(docs_frame(spark, [])).count() == 0


# --- op9


def slow_counts(t):
    t = t or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_counts(spark, data):
    rows = sample_texts(data) + [(None if i is None else 1000 + i, t) for i, t in AWKWARD] + [(2000, "a b c d e x a b c d e\n y \n y \ny"), (2001, "z z z z z z")]
    out = outliers.judged(docs_frame(spark, rows)).collect()
    want = Counter()
    for d, t in rows:
        n = slow_counts(t)
        want[(d, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])] += 1
    assert Counter((r.doc_id, *(r[c] for c in outliers.COUNTS), r.base_failed) for r in out) == want
    assert not any(r.kept for r in out if r.base_failed)
    assert outliers.judged(docs_frame(spark, [])).count() == 0


def test_mcd_resists_outliers():
    rnd = np.random.default_rng(9)
    x = np.vstack([rnd.normal(size=(800, 5)) * [1, 2, 0.5, 1, 1], rnd.normal(size=(150, 5)) + 40])
    m, s = outliers.mcd(x, np.ones(len(x)), floor=np.full(5, 1e-3))
    assert np.abs(m).max() < 0.3 and np.diag(s) == pytest.approx([1, 4, 0.25, 1, 1], rel=0.35)
    d = outliers._distances(x, m, s)
    assert (d[800:] > outliers.chi2_quantile(1 - 1e-6, 5)).all() and (d[:800] > outliers.chi2_quantile(1 - 1e-6, 5)).sum() <= 2
    whole, w = np.unique(np.round(x * 4), axis=0, return_counts=True)
    a, b = outliers.mcd(whole, w.astype(float)), outliers.mcd(np.repeat(whole, w, axis=0), np.ones(w.sum()))
    assert a[0] == pytest.approx(b[0], abs=0.02)
    assert outliers.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_outliers_go_and_clean_texts_stay(spark):
    import duckdb

    rows = duckdb.connect().sql("SELECT d.doc_id, text, lang, source, quality FROM '/root/testdata/sf0.01/documents.parquet' d LEFT JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id)").fetchall()
    d = spark.createDataFrame([(*r[:4], None, "r", 1, "x") for r in rows], DOCS)
    kept = {r.doc_id: r.kept for r in outliers.judged(d).collect()}
    good, bad = [kept[r[0]] for r in rows if r[4] == 1], [kept[r[0]] for r in rows if r[4] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    same = outliers.kept_documents(d)
    assert same.columns == d.columns and sorted(r.doc_id for r in same.collect()) == sorted(k for k, v in kept.items() if v)


def slow_distances(x, rnd):
    """Squared distances of plain rows from the best of 60 random starts, each concentrated on whole rows."""
    floor, p, h = np.diag(outliers.FLOOR**2), x.shape[1], int(0.75 * len(x))
    best = None
    for _ in range(60):
        part, before = x[rnd.choice(len(x), p + 1, replace=False)], None
        for _ in range(60):
            m, s = part.mean(0), np.cov(part.T, bias=True) + floor
            near = np.sort(np.argsort(outliers._distances(x, m, s), kind="stable")[:h])
            if before is not None and (near == before).all():
                break
            part, before = x[near], near
        det = np.linalg.det(s)
        if best is None or det < best[0]:
            best = det, m, s
    _, m, s = best
    scale = 0.75 / outliers._chi2_cdf(outliers.chi2_quantile(0.75, p), p + 2)
    return outliers._distances(x, m, (s - floor) * scale + floor)


def test_verdicts_against_a_slow_search(spark):
    """Whole rows and unrounded statistics give the same verdicts, but within a tenth of the limit."""
    import duckdb

    rows = duckdb.connect().sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    d = spark.createDataFrame([(*r, None, "r", 1, "x") for r in rows], DOCS)
    kept = {r.doc_id: r.kept for r in outliers.judged(d).collect()}
    stats, pools, langs = {}, {}, {}
    for i, t, lang, source in rows:
        n, chars, symbols, lines, repeats = slow_counts(t)
        if n >= 10 and 100 * repeats <= 20 * n:
            stats[i] = [math.log2(1 + n), math.log2(1 + chars / n), *(math.log2(1 + 1000 * c / n) for c in (symbols, lines, repeats))]
            pools.setdefault((lang, source), []).append(i)
            langs.setdefault(lang, []).append(i)
        else:
            assert not kept[i]
    cut, rnd, seen = outliers.chi2_quantile(1 - 1e-6, 5), np.random.default_rng(3), Counter()
    for (lang, _), ids in pools.items():
        pool = next(x for x in (ids, langs[lang], list(stats)) if len(x) >= 100 or len(x) == len(stats))
        far = dict(zip(pool, slow_distances(np.array([stats[i] for i in pool]), rnd)))
        for i in ids:
            if abs(far[i] / cut - 1) > 0.1:
                assert kept[i] == (far[i] <= cut), (i, far[i], cut)
                seen[kept[i]] += 1
    assert sum(seen.values()) > 0.97 * len(stats), seen


# --- op10


def test_rollups(spark):
    rnd = random.Random(10)
    store = rollups.Rollup(spark, scratch(spark, "rollup"))
    facts, state = [], {}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, n_tokens long")
    for i in [*range(60), None]:
        for v in ("a", "b"):
            f = (i, rnd.choice(["x", "y", None]), rnd.choice(["en", "de"]), v, rnd.randint(0, 99))
            facts.append(f)
            state[i, v] = f
    totals = lambda: Counter({(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in store.totals().collect()})

    def want():
        out = {}
        for f in state.values():
            n, k = out.get(f[1:4], (0, 0))
            out[f[1:4]] = n + 1, k + f[4]
        return Counter(out)

    assert totals() == Counter()
    assert store.apply("one", inserts=frame(facts)) and not store.apply("one", inserts=frame(facts))
    assert totals() == want()
    new = [(i, "z", "en", "a", 1000 + i) for i in range(0, 70, 7)]
    assert store.apply("two", revisions=frame(new), deletes=spark.createDataFrame([(1,), (1,), (999,), (None,)], "doc_id long"))
    for f in new:
        state[f[0], "a"] = f
    for v in ("a", "b"):
        state.pop((1, v))
        state.pop((None, v))
    assert totals() == want()
    # a batch that broke off before its commit leaves rows that nobody reads, and is written anew
    frame([(5, "q", "q", "q", 5)]).withColumn("n_docs", F.lit(1).cast("long")).write.parquet(f"{store.path}/rows/batch=three")
    assert totals() == want()
    assert store.apply("three", deletes=spark.createDataFrame([(2, "a")], "doc_id long, version string")) and not store.apply("two", inserts=frame(facts))
    state.pop((2, "a"))
    assert totals() == want()
    assert store.apply("four", inserts=frame([])) and totals() == want()


def test_rollups_read_the_buckets_of_a_batch_alone(spark, monkeypatch):
    monkeypatch.setattr(rollups, "FACTS", 8)
    store = rollups.Rollup(spark, scratch(spark, "rollup"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, version string, n_tokens long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    store.apply("b1", inserts=frame([(i, "s", "en", "a", i or 0) for i in [*range(200), None]]))
    store.apply("b2", revisions=frame([(i, "t", "en", "a", 1) for i in range(0, 200, 10)]))
    folders = lambda df: {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert len(folders(store._facts())) == 32 and store._live() == {"b1": 32, "b2": 8}
    one = store._facts(ids(7))
    scans = [x for x in one._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x and "bucket" in x]
    assert len(scans) == 2 and [(r.doc_id, r.n_tokens) for r in one.collect()] == [(7, 7)]
    assert [(r.doc_id, r.source) for r in store.standing(ids(None, 20)).orderBy("doc_id").collect()] == [(None, "s"), (20, "t")]
    # what a batch both deletes and revises goes once
    store.apply("b3", deletes=ids(20, 21, None), revisions=frame([(20, "u", "en", "a", 5)]))
    want = {("s", 179, sum(i for i in range(200) if i % 10 and i != 21)), ("t", 19, 19), ("u", 1, 5)}
    got = lambda: {(r.source, r.n_docs, r.n_tokens) for r in store.totals().collect()}
    stands = sorted(map(str, store.standing().collect()))
    assert got() == want and len(stands) == 199
    # folded batches stay known
    assert store.compact("all") and not store.compact("all") and not store.apply("b1", inserts=frame([(1, "s", "en", "a", 1)]))
    assert list(store._live()) == ["all"] and got() == want and sorted(map(str, store.standing().collect())) == stands
    store.apply("b4", deletes=ids(20, 30))
    assert got() == (want - {("t", 19, 19), ("u", 1, 5)}) | {("t", 18, 18)}


def test_rollups_of_real_tokenizers(spark, data):
    from tokenizers import Tokenizer

    rows = sample_texts(data, 60) + [(None if i is None else 1000 + i, t) for i, t in AWKWARD]
    files = {"bpe-50k": tokenizer_file()}
    out = rollups.encoded(docs_frame(spark, rows), files)
    whole = Tokenizer.from_file(files["bpe-50k"])
    want = Counter((d, "s", "en", "bpe-50k", len(whole.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert Counter(map(tuple, out.collect())) == want
    store = rollups.Rollup(spark, scratch(spark, "rollup"))
    store.apply("all", inserts=out)
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "bpe-50k", len(rows), sum(k[4] * n for k, n in want.items()))]
    assert rollups.encoded(docs_frame(spark, []), files).count() == 0
    assert {(r.doc_id, r.version): r.n_tokens for r in rollups.counted(docs_frame(spark, AWKWARD)).collect()}[7, "words-1"] == 30000


def test_registered_queries(spark, data):
    """Those with SQL against it, the others run."""
    import os

    import duckdb

    from proofloom.llm import queries

    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{data}/{f}'")
    for name, sql in queries.oracle_sql().items():
        df, want = queries.queries()[name](spark, data), con.sql(sql)
        at = [want.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in at) for r in want.fetchall()), name
