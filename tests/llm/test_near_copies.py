"""The pipeline's near copies: against brute force, recall by size of group and length of text, and large groups."""

import random
from collections import Counter

import numpy as np
import pytest

from proofloom.llm import common, simhash
from test_llm import docs_frame, low, sample_texts, split

P = simhash.PRINTS


def shingles(t, n=5):
    w = split(low(t))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def slow_pairs(rows):
    """(a, b, same words, differing bits of each word of the prints, Jaccard similarity) of all pairs of documents that differ little."""
    own = {d: t or "" for d, t in reversed(rows) if d is not None}
    ids = sorted(own)
    words, sets = {d: split(low(own[d])) for d in ids}, {d: shingles(own[d]) for d in ids}
    prints = dict(zip(ids, simhash.wide_prints([own[d].encode() for d in ids])[1]))
    out = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            bits = np.bitwise_count(prints[a] ^ prints[b]).astype(int)
            x, y = sets[a], sets[b]
            j = len(x & y) / len(x | y) if 2 * min(len(x), len(y)) >= 0.5 * max(len(x), len(y)) else 0.0
            if words[a] == words[b] or bits[P:].sum() <= simhash.LOOSE_BITS or j >= 0.5:
                out.append((a, b, words[a] == words[b], bits, j))
    return ids, out


def slow_roots(ids, pairs, alike):
    """Components of documents of the same words, or of which ``alike`` (bits, Jaccard) holds."""
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b, same, bits, j in pairs:
        if same or alike(bits, j):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: find(d) for d in ids}


def near_copies(data, n=25, seed=11):
    """Texts with edits every 60 to 70 words, so that copies are near to their text rather than to each other."""
    rnd = random.Random(seed)
    rows = [r for r in sample_texts(data, 120)]
    long = [t for _, t in rows if 130 < len(split(t)) < 800][:4]
    for k, t in enumerate(long):
        for i in range(n):
            w = t.split(" ")
            for at in range(rnd.randint(0, 40), len(w), rnd.randint(60, 70)):
                w[at] = f"edit{rnd.randrange(10**6)}"
            rows.append((1000 + 100 * k + i, " ".join(w)))
    return rows + [(3000 + d, t.upper() if t else t) for d, t in rows[:10]]


def slow_wide_print(t):
    """Each fingerprint bit by bit, with a word counted in each of its shingles."""
    import hashlib

    import xxhash

    w = split(low(t))
    grams = [w[i : i + 5] for i in range(len(w) - 4)] or [w]
    of_words = [hashlib.blake2b(x.encode(), digest_size=8 * P).digest() for g in grams for x in g]
    if not w:
        of_words = []
    of_grams = [xxhash.xxh3_128_digest(" ".join(g).encode()) + xxhash.xxh3_128_digest(" ".join(g).encode(), 1) for g in grams]

    def majority(hashes, n):
        bits = [sum(h[b // 8] >> (7 - b % 8) & 1 for h in hashes) * 2 > len(hashes) for b in range(8 * n)]
        return bytes(sum(x << (7 - i) for i, x in enumerate(bits[k : k + 8])) for k in range(0, 8 * n, 8))

    return majority(of_words, 8 * P) + majority(of_grams, 32)


def test_prints_bit_by_bit():
    rnd = random.Random(4)
    texts = ["", " ", "a", "a b c d", "a b c d e", "a B c d e f", "a a a b a a", " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(60))]
    digests, prints, keys = simhash.wide_prints([t.encode() for t in texts])
    assert [p.tobytes() for p in prints] == [slow_wide_print(t) for t in texts]
    assert digests[0] == digests[1] and len(set(digests)) == len(texts) - 1
    assert all(len(k) == simhash.BANDS for k in keys) and simhash.wide_prints([b"a " * 69])[2] == [None]


def test_copies_against_brute_force(spark, data):
    rows = near_copies(data) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one word more"), (9003, "one word more"), (None, "no id"), (None, "no id")]
    slow = slow_pairs(rows)
    judged = lambda d: d[P:].sum() <= simhash.LOOSE_BITS
    least = slow_roots(*slow, lambda d, j: j >= 0.8 and judged(d) and min(d[:P]) <= simhash.PRINT_RADIUS)  # what the covering tables guarantee
    exact = slow_roots(*slow, lambda d, j: j >= 0.8)
    for bucket_rows in (2048, 96):
        got = {r.doc_id: r.root for r in simhash.alike(docs_frame(spark, rows), bucket_rows=bucket_rows).collect()}
        assert got.keys() == exact.keys()
        assert all(got[d] == got[r] for d, r in least.items())
        assert all(exact[d] == exact[r] for d, r in got.items()), "no link under 0.8"
        assert np.mean([got[d] == got[r] for d, r in exact.items()]) > 0.99
    # groups too large for one task are judged by their fingerprints
    tight, loose = slow_roots(*slow, lambda d, j: d[P:].sum() <= simhash.SHINGLE_BITS and min(d[:P]) <= simhash.PRINT_RADIUS), slow_roots(*slow, lambda d, j: j >= 0.5)
    got = {r.doc_id: r.root for r in simhash.alike(docs_frame(spark, rows), group_texts=1).collect()}
    assert all(got[d] == got[r] for d, r in tight.items()) and all(loose[d] == loose[r] for d, r in got.items())


def test_groups_too_large_for_one_task_are_compared_exactly(spark, data):
    """The size of a group of candidates, and of what a task holds, does not change which texts are linked."""
    rows = near_copies(data, n=12)
    ids, pairs = slow_pairs(rows)
    exact = slow_roots(ids, pairs, lambda d, j: j >= 0.8)
    assert slow_roots(ids, pairs, lambda d, j: d[P:].sum() <= simhash.SHINGLE_BITS) != exact, "fingerprints alone would tell another border"
    for bucket_rows in (simhash.BUCKET_ROWS, 96):
        whole, dealt = ({r.doc_id: r.root for r in simhash.alike(docs_frame(spark, rows), bucket_rows=bucket_rows, task_texts=n).collect()} for n in (simhash.TASK_TEXTS, 4))
        assert whole == dealt
        assert all(exact[d] == exact[r] for d, r in dealt.items()) and np.mean([dealt[d] == dealt[r] for d, r in exact.items()]) > 0.99


def test_rows_near_to_no_other_are_left_out():
    """A bucket of many fingerprints: the same trees whether or not lone rows are left out first."""
    rnd = np.random.default_rng(5)
    prints = rnd.integers(0, 1 << 63, (700, simhash.SHINGLE_WORDS), np.uint64)
    for at, bits in ((10, 54), (300, 54), (400, 55), (650, 1)):  # a copy of the row before, so many bits away
        flips = np.zeros(64 * simhash.SHINGLE_WORDS, np.uint8)
        flips[rnd.choice(len(flips), bits, replace=False)] = 1
        prints[at] = prints[at - 1] ^ np.packbits(flips).view(np.uint64)
    assert simhash._met(prints, 54).tolist() == [9, 10, 299, 300, 649, 650]
    assert sorted(simhash.judged_pairs(prints, 54)) == [(9, 10), (299, 300), (649, 650)]


def test_exact_pairs_against_all_pairs():
    rnd = random.Random(31)
    for n, words in ((1, 30), (2, 30), (60, 40), (200, 90)):
        base = [f"{i}" for i in range(words)]
        texts = []
        for _ in range(n):
            w = list(base if rnd.random() < 0.7 else rnd.choices(base, k=words))
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
            texts.append(" ".join(w))
        texts += ["", "a", "a b", texts[0]]
        root = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if jaccard(texts[a], texts[b]) >= 0.8:
                    root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        got = list(range(len(texts)))
        pairs = simhash.exact_pairs([simhash.shingle_set(t.encode()) for t in texts])
        for a, b in pairs:
            assert got[a] != got[b], "a forest"
            got = [min(got[a], got[b]) if r in (got[a], got[b]) else r for r in got]
        assert got == root


def test_no_document_is_lost_to_a_text_under_four_fifths(spark):
    """Chains of texts, each alike to the next in 0.66 to 0.79 of its shingles, and short and long pairs just at either side."""
    rnd, rows, kept = random.Random(41), [], 0
    for c in range(12):
        w = [f"{rnd.randrange(10**9)}" for _ in range(60)]
        for i in range(6):
            rows.append((100 * c + i, " ".join(w)))
            w = list(w)
            for at in (9 + 4 * i, 10 + 4 * i, 11 + 4 * i, 12 + 4 * i):
                w[at] = f"{rnd.randrange(10**9)}"
            assert 0.6 <= jaccard(rows[-1][1], " ".join(w)) < 0.8
            kept += 1
    assert simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).count() == kept


def test_short_texts_with_words_in_front(spark):
    """Two thousand pairs of 20 words, of which the copy has four words more: Jaccard 0.8."""
    rnd, rows = random.Random(42), []
    for k in range(2000):
        w = [f"{rnd.randrange(10**9)}" for _ in range(20)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([f"new{i}{rnd.randrange(10**6)}" for i in range(4)] + w))]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8
    roots = {r.doc_id: r.root for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([roots[2 * k + 1] == 2 * k for k in range(2000)]) >= 0.97 and all(roots[2 * k] == 2 * k for k in range(2000))


def test_hot_band_of_short_texts(spark):
    """A band's bucket with more fingerprints than it may have is split by the other bands, without losing its pairs."""
    rnd, rows = random.Random(43), []
    base = [f"{rnd.randrange(10**9)}" for _ in range(50)]
    for i in range(300):
        rows.append((i, " ".join(base[:-6] + [f"{rnd.randrange(10**9)}" for _ in range(3)] + base[-3:])))
    got = Counter(r.root for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=32).collect())
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    assert sum(got.values()) == 300 and len(got) == 300 - len(simhash.exact_pairs(sets))


def edits(rnd, w, kind):
    """One edit: a word in the middle replaced, the last replaced, one put in front, one put in the middle."""
    w, new = list(w), f"edit{rnd.randrange(10**6)}"
    if kind == "middle":
        w[rnd.randrange(5, len(w) - 5)] = new
    elif kind == "last":
        w[-1] = new
    elif kind == "front":
        w.insert(0, new)
    else:
        w.insert(rnd.randrange(5, len(w) - 5), new)
    return w


def test_recall_by_length_of_text():
    """Pairs of two documents only, all words different: candidates if a table or band joins them and the fingerprints of their shingles agree."""
    rnd, found = random.Random(5), {}
    for n, kinds in ((14, "last front"), (20, "last front"), (30, "last front"), (52, "middle"), (60, "middle inside"), (120, "middle inside"), (400, "middle inside")):
        for kind in kinds.split():
            for many in (1, 2, 4, 8):
                hits = total = 0
                for _ in range(150):
                    a = [f"{rnd.randrange(10**9)}" for _ in range(n)]
                    b = a
                    for _ in range(many):
                        b = edits(rnd, b, kind)
                    if jaccard(" ".join(a), " ".join(b)) < 0.8:
                        continue
                    _, (x, y), keys = simhash.wide_prints([" ".join(a).encode(), " ".join(b).encode()])
                    d = np.bitwise_count(x ^ y).astype(int)
                    total += 1
                    bands = keys[0] and keys[1] and any(p == q for p, q in zip(*keys))
                    hits += bool((min(d[:P]) <= simhash.PRINT_RADIUS or bands) and d[P:].sum() <= simhash.LOOSE_BITS)
                if total >= 50:
                    found[n, kind, many] = round(hits / total, 3)
    assert len(found) > 25 and min(found.values()) >= 0.9 and np.mean(list(found.values())) >= 0.98, found


def test_many_copies_with_one_fingerprint(spark):
    """A group far beyond a bucket: a long text and copies with one edit each, most of which have the fingerprints of the text."""
    rnd = random.Random(12)
    text = [f"{rnd.choice('bcdfg')}{i % 397}" for i in range(1500)]
    rows = [(0, " ".join(text))]
    for i in range(1, 400):
        w = list(text)
        w[rnd.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    out = simhash.alike(docs_frame(spark, rows), bucket_rows=96).collect()
    assert {r.root for r in out} == {0} and len(out) == 400


def test_recall_in_a_group_of_20000(spark):
    """Copies of one text with edits at every 60 to 80 words: near to the text, not to each other."""
    rnd = random.Random(14)
    text = [f"{rnd.choice('bcdfg')}{rnd.randrange(900)}" for _ in range(240)]
    rows, near = [(0, " ".join(text))], 0
    for i in range(1, 20_001):
        w = list(text)
        for at in range(rnd.randint(0, 40), len(w), rnd.randint(60, 80)):
            w[at] = f"edit{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    near = [i for i in range(1, 2001) if jaccard(rows[0][1], rows[i][1]) >= 0.8]
    roots = {r.doc_id: r.root for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 1000 and np.mean([roots[i] == 0 for i in near]) >= 0.98


def test_star_of_copies_with_one_fingerprint(spark):
    """Copies with the words of a text in other places: near to the text, mostly not to each other, and far beyond a bucket."""
    rnd = random.Random(13)
    text = [f"{rnd.choice('bcdfg')}{i}" for i in range(1500)]
    rows = [(1000, " ".join(text))]
    for i in range(400):
        w = list(text)
        for at in rnd.sample(range(8, 1480, 8), 27):
            w[at], w[at + 1] = w[at + 1], w[at]
        rows.append((i, " ".join(w)))
    prints = simhash.wide_prints([t.encode() for _, t in rows])[1]
    assert (prints[:, :P] == prints[0, :P]).all()
    sets = [shingles(t) for _, t in rows]
    near = np.array([[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    ids = [d for d, _ in rows]
    root = np.array(ids)
    for _ in rows:
        root = np.where(near, root, 9999).min(1)
    want = dict(zip(ids, root.tolist()))
    assert Counter(want.values()).most_common(1)[0][1] > 200
    assert {r.doc_id: r.root for r in simhash.alike(docs_frame(spark, rows), bucket_rows=96).collect()} == want
    several = np.ascontiguousarray(np.concatenate([prints[:, P:]] * 6))  # beyond what is compared at once
    once = len(simhash.judged_pairs(np.ascontiguousarray(prints[:, P:])))
    assert len(simhash.judged_pairs(several)) == once + 5 * len(prints)


def test_deduplicated_keeps_one_of_each(spark, data):
    rows = near_copies(data) + [(9003, "one word more"), (9003, "one word more"), (None, "no id"), (None, "no id")]
    d = docs_frame(spark, rows)
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns
    roots = {r.doc_id: r.root for r in simhash.alike(d).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r: 1 for r in roots.values()} | {None: 2})
    assert simhash.deduplicated(d.limit(0)).count() == 0


def test_one_doc_id_with_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    near = one.replace("a40", "zz")
    rows = [(1, one), (1, two), (1, one), (2, two), (3, near), (1, near), (4, None), (4, ""), (4, " ")]
    kept = Counter((r.doc_id, r.text) for r in simhash.deduplicated(docs_frame(spark, rows)).collect())
    assert sum(kept.values()) == 3 and kept[1, two] == 1 and kept[1, one] + kept[1, near] == 1
    assert sum(n for (i, t), n in kept.items() if i == 4) == 1


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm = spark._jvm
    empty = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, empty, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_copies_are_not_shuffled(spark):
    """As where tables are too large to be sent to all tasks: only the texts of copies, and of rows that repeat, go through a shuffle."""
    rnd = random.Random(5)
    text = lambda n: " ".join("%08x" % rnd.getrandbits(32) for _ in range(n))
    rows = [(k, text(3000)) for k in range(120)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (201, rows[7][1] + " more"), (None, "without a number"), (None, "without a number")]
    size = sum(len(t) for _, t in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, at = docs_frame(spark, rows).cache(), shuffled(spark)
        docs.count()
        found = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.deduplicated(docs.select("doc_id", "text")).collect())
        moved = shuffled(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [(False, k) for k in range(120)] + [(True, 0)] * 2
    assert moved < size / 2, (moved, size)


def test_sieve_passes_all_matches(spark):
    keys = spark.range(0, 40_000, 7).selectExpr("id AS i", "cast(id AS string) AS k")
    rows = spark.range(40_000).selectExpr("id AS i", "cast(id AS string) AS k").union(spark.createDataFrame([(None, "7"), (7, None)], "i long, k string"))
    for most, share in ((common.SIEVE_BITS, 1 / 16), (1 << 15, 0.2)):
        out = common.may_match(rows, keys, ["i", "k"], most)
        hit = {(r.i, r.k) for r in out.filter("may").collect()}
        assert hit >= {(k, str(k)) for k in range(0, 40_000, 7)} and out.count() == 40_002
        assert len(hit) - 40_000 / 7 <= share * 40_000 + 2
    assert common.may_match(rows, keys.limit(0), ["i", "k"]).filter("may").isEmpty()
