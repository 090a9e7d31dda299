"""Prefix trie, language identification and hard negatives: against brute force and DuckDB, and on odd inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.llm import negatives, ppm, queries, scans, trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(vs)] for c, vs in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *own[c][h:])
    members = defaultdict(list)
    for c, q in seqs.items():
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    out = []
    for q, m in members.items():
        below = [n for n in members if n[: len(q)] == q]
        kids = [n for n in below if len(n) == len(q) + 1]
        leaves = [n for n in below if not any(k[:-1] == n for k in members if k)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ids = ",".join(map(str, sorted(c for c in m if seqs[c] == q)))
        out.append((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


def nodes(spark, rows, schema=TURNS):
    return trie.nodes(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        c = rng.choice([rng.randrange(320), 100 * rng.randrange(4), -rng.randrange(250)])
        for _ in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None, "é"]), rng.choice(["a", "b", "", None, "ein längerer Satz 😀"])))
    rows += [(None, 1, "user", "x")] * 3
    got = nodes(spark, rows).collect()
    assert Counter(tuple(r)[:8] for r in got) == trie_by_hand(rows)
    # preorder intervals: places are 1 to n, every interval ends in it, and two either nest or are apart
    assert sorted(r["preorder"] for r in got) == list(range(1, len(got) + 1))
    spans = sorted((r["preorder"], r["end"], r["depth"]) for r in got)
    for (a, b, d), (x, y, e) in zip(spans, spans[1:]):
        assert (x <= b) == (e == d + 1 and y <= b) or (x <= b and y <= b)


def test_trie_of_long_and_equal_conversations(spark):
    """More than one run of turns, a difference far down, one the beginning of another, and many copies."""
    long = [(t, "user", f"turn {t}") for t in range(1500)]
    rows = [(7, *x) for x in long] + [(8, *x) for x in long[:1400]] + [(9, *x) for x in [*long[:1100], (1100, "user", "else"), *long[1101:]]]
    rows += [(1000 + k, 0, "user", "hello") for k in range(500)]
    got = {(r["conv_id"], r["depth"]): r for r in nodes(spark, rows).collect()}
    by = defaultdict(list)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in (7, 8, 9)}
    for c, seq in ((7, long), (8, long[:1400]), (9, [*long[:1100], (1100, "user", "else"), *long[1101:]])):
        by[c] = [x[1:] for x in seq[h[c] :]]  # conversation 0 does not exist
    members = Counter(tuple(by[c][:d]) for c in by for d in range(1, len(by[c]) + 1))
    long_nodes = [r for r in got.values() if r["depth"] > 0 and r["conv_id"] in by]
    assert len(long_nodes) == len(members)
    root = next(r for r in got.values() if r["depth"] == 0)
    assert root["n_convs"] == 503 and root["end"] == len(got) and root["n_leaves"] == sum(r["n_children"] == 0 for r in got.values())


def test_trie_odd_inputs(spark):
    assert nodes(spark, []).count() == 0
    assert nodes(spark, [(None, 1, "u", "x")]).count() == 0
    only = nodes(spark, [(1, 1, "u", "x")]).collect()  # its one turn is replaced by those of conversation 0, which is not there, if h > 0
    assert [r["depth"] for r in sorted(only, key=lambda r: r["depth"])] == [0] + [1] * (zlib.crc32(b"1") % 6 == 0)
    own = spark.createDataFrame([(1, 1, "u", "x", 5, "y")], TURNS + ", pos int, h1 string")
    assert trie.nodes(own).count() == len(only)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.randrange(-(10**6), 10**6), rng.getrandbits(62)) for g in (1, 2, 3, 3, 4) for k in range(rng.choice([1, 5, 400]))]
    rows = list({(g, k): r for r in rows for g, k in [r[:2]]}.values())
    df = spark.createDataFrame(rows, "g long, k long, v long, x long").repartition(7)
    for group in (None, "g"):
        got = {r[:2]: (r["s"], r["y"]) for r in scans.running(df, ["g", "k"], {"s": "v"}, {"y": "x"}, group=group).collect()}
        s, y, last = 0, 0, None
        for g, k, v, x in sorted(rows):
            if group and g != last:
                s, y = 0, 0
            s, y, last = s + v, y ^ x, g
            assert got[g, k] == (s, y)
    assert scans.running(df.limit(0), ["g", "k"], {"s": "v"}, group="g").count() == 0


# Language identification


def code_length(sample, text, order=ppm.ORDER):
    """Bits by definition: contexts from the longest one seen, escapes with exclusion."""
    seen = defaultdict(Counter)
    for t in sample:
        t = ppm.PAD + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k : i]][t[i]] += 1
    bits, text = 0.0, ppm.PAD + text
    for i in range(order, len(text)):
        out = set()
        for k in range(order, -1, -1):
            c = seen.get(text[i - k : i])
            if c is None:
                continue
            left = {b: n for b, n in c.items() if b not in out}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if text[i] in left:
                bits -= math.log2(left[text[i]] / total)
                break
            bits -= math.log2(len(left) / total)
            out |= set(left)
        else:
            bits += math.log2(256 - len(out))
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(3)
    words = ["the", "thin", "on", "é", "over", "ox", "\n", "."]
    sample = [" ".join(rng.choices(words, k=30)).encode() for _ in range(4)]
    tree = ppm.Tree(sample)
    tests = [" ".join(rng.choices([*words, "zebra", "Ω"], k=20)).encode() for _ in range(5)] + [b"", b"a", bytes(range(256))]
    got = ppm.lengths([tree], tests)[:, 0]
    assert got == pytest.approx([code_length(sample, t) for t in tests])
    # probabilities of all bytes in a context sum to one
    for before in (b"\n\n\n\n", b" the", b"zzzz", b"n th"):
        g = np.array([int.from_bytes(before + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp2(-tree.bits(g)).sum() == pytest.approx(1)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    tree, text = ppm.Tree([b"some words and some more words"]), b"some more words, and others " * 50
    whole = ppm.lengths([tree], [text, b"x", text])[:, 0]
    monkeypatch.setattr(ppm, "CHUNK", 37)
    assert ppm.lengths([tree], [text, b"x", text])[:, 0] == pytest.approx(whole)


def test_language_id_on_documents(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = ppm.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_id_odd_inputs(spark):
    schema = "doc_id long, text string, lang string, score int, held_out string"
    rows = [(k, "wo der wind weht und das wasser fliesst" if k % 2 else "where the wind blows and water flows", "de" if k % 2 else "en", k, "x") for k in range(40)]
    odd = [(100, None, "en", 0, ""), (101, "", "en", 0, ""), (102, "12 34 ...", "de", 0, ""), (None, "the wind", None, 0, ""), (7, "und das", None, 0, ""), (7, "und das", None, 0, "")]
    got = ppm.predicted(spark.createDataFrame(rows + odd, schema)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] not in (7,)}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[None][0] == "en" and [r["lang_pred"] for r in got if r["doc_id"] == 7] == ["de"] * 3
    assert all(by[k][0] == ("de" if k % 2 else "en") for k in range(40) if k != 7)
    none = ppm.predicted(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]
    assert ppm.predicted(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    # many languages share the bytes of the sample; those with most rows are learnt
    many = spark.createDataFrame([(k, f"wort{k % 9} " * 30, f"l{k % 9}") for k in range(300)], "doc_id long, text string, lang string")
    assert len(ppm.trees(many, max_langs=4)) == 4


# Hard negatives


def negatives_by_hand(rows):
    own = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = Counter()
    for n, (i, label, v) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for k, (j, m, w) in enumerate(own) if k != n)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            ok = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out.update((i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(ok, 1))
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def near(rng, centre, spread):
    return [c + rng.gauss(0, spread) for c in centre]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "group": 2, "n_pivots": 5}])
def test_negatives_equal_brute_force(spark, sizes):
    rng = random.Random(5)
    centres = [near(rng, [0] * 6, 1) for _ in range(4)]
    rows = [(k, near(rng, rng.choice(centres), 0.2), rng.randrange(4)) for k in range(1200)]
    rows += [(2000 + k, rows[100][1], k % 3) for k in range(300)]  # a third of copies, ties
    rows += [(3000, None, 1), (3001, [float("nan")] * 6, 1), (3100, [None] + [1.0] * 5, 1), (3200, [1.0] * 6, None), (None, [1.0] * 6, 1), (3300, [float("inf")] * 6, 2)]
    rows += [rows[200], rows[200], (3400, [], 2), (3500, [0.5, 0.25], 1), (3600, [0.0] * 6, 9), (3700, [100.0] * 6, 3)]
    got = negatives.mined(spark.createDataFrame(rows, VECTORS), **sizes).collect()
    assert Counter(tuple(r) for r in got) == negatives_by_hand(rows)


def test_negatives_odd_inputs(spark):
    make = lambda rows: negatives.mined(spark.createDataFrame(rows, VECTORS + ", rank string, anchor_id int").select("*"))
    assert make([]).count() == 0
    assert make([(1, [1.0], 1, "", 0)]).count() == 0  # no anchor
    assert make([(0, [1.0], 1, "", 0)]).count() == 0  # nothing else
    assert make([(100, None, 1, "", 0)]).count() == 0
    rows = [(100, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (2, [0.5, 0.0], 2, "", 0), (3, [-1.0, 0.0], 1, "", 0)]
    assert [tuple(r) for r in make(rows).collect()] == [(100, 1, 1, 2, 65536, 32768)]  # a negative positive has no window


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op13_hard_negatives"])
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    rows = [tuple(r) for r in df.collect()]
    assert rows and Counter(rows) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_language_id_query(spark, data):
    out = queries.queries()["op12_language_id"](spark, data)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert out.filter(F.col("lang_pred").isNull() | F.col("score").isNull()).isEmpty()
