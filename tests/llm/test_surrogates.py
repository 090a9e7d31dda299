"""Surrogates against a slow reading of the same rules: what is replaced, by what kind of thing, and how consistently."""

import random
import re
import time
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from proofloom.llm import surrogates

from test_llm import AWKWARD, DOCS, docs_frame

PII = [
    (1, "Call Mrs. Anna Schmidt or Dr Schmidt at +1 (017) 555-7713 or +1 017 555 7713, mail ANNA@X.COM anna@x.com."),
    (2, "card 4111 1111 1111 1111 4111-1111-1111-1111 ip 1.2.3.4 version 1.2.3 on 2024-01-02"),
    (3, None), (4, ""), (5, 'Господин Иванов, Mr. Iwanow token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (6, "nothing to hide in 2024, or 12-34"), (2, "mail anna@x.com"),
]


def rewritten(spark, rows, key="key"):
    return surrogates.replaced(docs_frame(spark, rows), key).collect()


def test_surrogates(spark):
    out = rewritten(spark, PII)
    assert len(out) == len(PII) and out[0].__fields__ == [*DOCS.replace(",", "").split()[::2], "n_entities"]
    text = {(r.doc_id, r.n_entities): r.text for r in out}
    t = text[1, 7]
    assert not re.search(r"Anna|Schmidt|017|7713|ANNA|anna@", t)
    phones = re.findall(r"\+\d+ \(?\d+\)? \d+[- ]\d+", t)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and phones[0].startswith("+1 (")
    mails = re.findall(r"\S+@\S+\w", t)
    assert mails[0] == mails[0].upper() and mails[0].lower() == mails[1] and mails[1] in text[2, 1]
    woman, doctor = re.search(r"Mrs\. (\S+) (\S+) or Dr (\S+) at", t).groups()[:2], re.search(r"Dr (\S+)", t)[1]
    assert woman[1] == doctor and woman[0].endswith("a")
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) (\d{4}-\d{4}-\d{4}-\d{4}) ip (\d+\.\d+\.\d+\.\d+) version 1.2.3 on 2024-01-02", text[2, 3])
    digits = re.sub(r"\D", "", cards[1])
    assert digits == re.sub(r"\D", "", cards[2]) != "4" + "1" * 15
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    assert text[3, 0] is None and text[4, 0] == "" and text[6, 0] == PII[5][1]
    assert re.search(r"Господин [А-я]+, Mr\. [A-z]+ token = \"[0-9a-f]{40}\"", text[5, 3]) and "Иванов" not in text[5, 3]
    again = rewritten(spark, PII[::-1])
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in again)
    assert {r.text for r in rewritten(spark, PII, "other")} != {r.text for r in out}
    assert rewritten(spark, []) == []


def test_names_keep_coreference(spark):
    """Across letter case, title, place in the name, later mentions without a title, and documents."""
    rows = [
        (1, "Mr. SCHMIDT met Mr. Schmidt. Then Schmidt left, and SCHMIDT too; Schmidts stay."), (2, "Mrs Anna came. Mrs. Anna Schmidt left, Anna said."),
        (3, "Herr Otto Anna-Maria O'Neil und Dr Otto Schmidt"), (4, "Schmidt without a title here"),
    ]
    t = {r.doc_id: r.text for r in rewritten(spark, rows)}
    upper, plain, third, fourth = re.fullmatch(r"Mr\. (\w+) met Mr\. (\w+)\. Then (\w+) left, and (\w+) too; Schmidts stay\.", t[1]).groups()
    assert upper == upper.upper() == fourth and upper.title() == plain == third != "Schmidt"
    anna, again, last, said = re.fullmatch(r"Mrs (\w+) came\. Mrs\. (\w+) (\w+) left, (\w+) said\.", t[2]).groups()
    assert anna == again == said and anna.endswith("a") and last == plain
    m = re.fullmatch(r"Herr (\w+) (\w+)-(\w+) O'Neil und Dr (\w+) (\w+)", t[3])
    assert m and m[1] == m[4] and m[1].endswith("o") and m[2] == anna and m[5] == plain
    assert t[4] == rows[3][1]


def test_country_codes_and_first_octets_stay(spark):
    rows = [(1, "+44 20 7946 0018"), (2, "+49 (30) 1234 5678"), (3, "+420 601 123 456"), (4, "+1 212 555 0100"), (5, "192.168.7.9 8.8.8.8")]
    t = {r.doc_id: r.text for r in rewritten(spark, rows)}
    for i, code in ((1, "+44 "), (2, "+49 ("), (3, "+420 "), (4, "+1 ")):
        assert t[i].startswith(code) and t[i] != rows[i - 1][1] and re.sub(r"\d", "0", t[i]) == re.sub(r"\d", "0", rows[i - 1][1])
    assert re.fullmatch(r"192\.\d+\.\d+\.\d+ 8\.\d+\.\d+\.\d+", t[5])


def test_shortest_entities_alone(spark):
    rows = list(enumerate(["a@b.cc", "a1b2c3d4e5f6" * 2 + "a1b2c3d4", "8.8.8.8", "4 1 1 1 1 1 1 1 1 1 1 1 1", "+1(2)(3)", "Dr Xu"]))
    out = {r.doc_id: r for r in rewritten(spark, rows)}
    assert [out[i].n_entities for i, _ in rows] == [1] * len(rows)
    assert all(out[i].text != t for i, t in rows)


def test_surrogates_stay_distinct_where_they_clash(spark):
    """Spaces that are nearly or wholly full: all numbers of two free digits, dense addresses, 3000 name words of three syllables."""
    rows = [("ip", f"10.0.{i // 250}.{i % 250}", "n") for i in range(3000)] + [("card", f"{4000000000000 + i}", "n") for i in range(500)]
    rows += [("phone", f"+1{i:02d}", "n") for i in range(100)] + [("word", f"name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "n") for i in range(3000)]
    e = spark.createDataFrame(rows, "kind string, canonical string, ending string")
    out = surrogates.mapping(e.union(e), "k").collect()
    assert len(out) == len(rows) == len({(r.kind, r.replacement) for r in out})
    assert not {(r.kind, r.replacement) for r in out} & {r[:2] for r in rows}
    assert {len(r.replacement) for r in out if r.kind == "phone"} == {5}, "the space of two digits is full, so numbers grow"


def test_addresses_end_where_no_free_one_is_left(spark, monkeypatch):
    """After IP_ATTEMPTS an address takes its first replacement, though the table has it."""
    monkeypatch.setattr(surrogates, "IP_ATTEMPTS", 0)
    rows = [("ip", f"10.0.{i // 250}.{i % 250}", "n") for i in range(500)]
    first = {r.canonical: r.replacement for r in surrogates.derived(spark.createDataFrame(rows, "kind string, canonical string, ending string"), "k", 0).collect()}
    full = rows + [("ip", v, "n") for v in list(first.values())[:50]]
    out = surrogates.mapping(spark.createDataFrame(full, "kind string, canonical string, ending string"), "k").collect()
    assert len(out) == len({r[1] for r in full}) == len({r.replacement for r in out})
    assert {r.canonical: r.replacement for r in out}.items() >= first.items()


def test_awkward_texts_and_columns(spark):
    for r, (i, t) in zip(sorted(rewritten(spark, AWKWARD), key=str), sorted(AWKWARD, key=str)):
        assert r.n_entities == 0
    assert Counter((r.doc_id, r.text) for r in rewritten(spark, AWKWARD)) == Counter(AWKWARD)
    long = "word " * 200_000 + "mail a.b@c.example.org " * 2000
    (row,) = rewritten(spark, [(1, long)])
    assert row.n_entities == 2000 and row.text.startswith("word " * 200_000) and "c.example.org" not in row.text
    odd = spark.createDataFrame([("a@b.cc", 7, 8, None)], "text string, N_ENTITIES int, id int, `a.b` string")
    out = surrogates.replaced(odd, "k")
    assert out.columns == ["text", "N_ENTITIES", "id", "a.b", "n_entities_2"] and out.first()[1:] == (7, 8, None, 1)


def slow_units(text):
    """(start, end, kind, canonical) by a scan of the text in Python."""
    titled = regex.compile(surrogates.TITLED)
    names = {w for m in titled.finditer(text) for g in (m[2], m[3]) if g for w in regex.findall(r"\p{L}{2,}", g)}
    names = sorted({v for w in names for v in (w, w.upper(), w[0].upper() + w[1:].lower())})
    pattern = surrogates.NUMBERED + (r"|(?<!\p{L})(?:" + "|".join(names) + r")(?!\p{L})" if names else "")
    for m in regex.finditer(pattern, text):
        u = m[0]
        digits = re.sub(r"\D", "", u)
        if "@" in u:
            yield (*m.span(), "email", u.lower())
        elif u.isalpha():
            yield (*m.span(), "word", u.lower())
        elif re.fullmatch(r"[0-9a-fA-F]{32,}", u) and re.search("[a-fA-F]", u):
            yield (*m.span(), "secret", u.lower())
        elif re.fullmatch(r"\d+\.\d+\.\d+\.\d+", u) and len(digits) <= 12:
            yield (*m.span(), "ip", u)
        else:
            yield (*m.span(), "card" if len(digits) > 12 and u[0] != "+" and u[0] != "(" else "phone", "+" * (u[0] == "+") + digits)


def test_given_documents_against_a_slow_scan(spark, data):
    """All text outside of the units stays, and unit to replacement is one to one over the table."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, (_, t) in enumerate(PII)], "doc_id long, text string")).withColumn("text", F.col("text"))
    before = {r.doc_id: r.text for r in docs.collect()}
    told, back = {}, {}
    n = 0
    for r in surrogates.replaced(docs, "k").collect():
        text, new = before[r.doc_id], r.text
        units = list(slow_units(text or ""))
        assert r.n_entities == len(units)
        if not units:
            assert new == text
            continue
        # the gaps stand in the new text in their order, and between them units of the old one's shape
        ends = [0, *[u[1] for u in units]]
        gaps = [text[a:b] for a, b in zip(ends, [*[u[0] for u in units], len(text)])]
        shapes = [f"({re.sub(chr(92) + 'd', '0', regex.escape(text[a:b])).replace('0', '[0-9]')})" if k in ("card", "phone") else r"([^\s\"']+?)" for a, b, k, _ in units]
        made = regex.fullmatch("".join(x for pair in zip(map(regex.escape, gaps), [*shapes, ""]) for x in pair), new, regex.S)
        assert made, (text, new)
        for (_, _, kind, canonical), got in zip(units, made.groups()):
            shape = re.sub(r"\D", "", got) if kind in ("card", "phone") else got.lower()
            assert told.setdefault((kind, canonical), shape) == shape and back.setdefault((kind, shape), canonical) == canonical
            n += 1
    assert n > 30


def test_names_end_by_the_gender_that_titles_tell(spark):
    rows = [
        (1, "Госпожа Иванова, Господин Петров, Κυρία Παππά, Κύριος Νικολάου"), (2, "Mrs Jones; Mr Stone; Mr Smith, Mrs Smith and Dr Blank"),
        (3, "Mrs Anna Kern met Dr Anna Kern, Mr Otto Busch, Dr Kim Lee"), (4, "Frau Maria. Herr Otto Maria Busch"),
    ]
    t = {r.doc_id: r.text for r in rewritten(spark, rows)}
    last = lambda i: [w[-1] for w in re.findall(r"\w+", t[i])]
    assert last(1)[1::2] == ["а", "н", "α", "ν"]
    assert [w[-1] for w in re.fullmatch(r"Mrs (\w+); Mr (\w+); Mr (\w+), Mrs (\w+) and Dr (\w+)", t[2]).groups()] == ["a", "n", "n", "n", "n"]
    names = re.fullmatch(r"Mrs (\w+) (\w+) met Dr (\w+) (\w+), Mr (\w+) (\w+), Dr (\w+) (\w+)", t[3]).groups()
    assert names[:2] == names[2:4] and [w[-1] for w in names] == ["a", "a", "a", "a", "o", "n", "e", "n"]
    maria, otto, again = re.fullmatch(r"Frau (\w+)\. Herr (\w+) (\w+) \w+", t[4]).groups()
    assert maria == again and otto == names[4] and otto.endswith("o")


def test_word_tree_is_the_alternation_of_its_words(spark):
    rnd = random.Random(3)
    sets = [sorted({"".join(rnd.choice("aбAXs") for _ in range(rnd.randint(2, 5))) for _ in range(n)}) for n in (1, 2, 40, 400)] + [["Xu", "Xua", "Xuan"], ["ab"]]
    trees = [r.p for r in spark.createDataFrame([(i, ws) for i, ws in enumerate(sets)], "i int, ws array<string>").orderBy("i").select(surrogates.word_tree("ws").alias("p")).collect()]
    for ws, tree in zip(sets, trees):
        text = " ".join("".join(rnd.choice("aбAXsu") for _ in range(rnd.randint(1, 6))) for _ in range(3000)) + " " + " ".join(ws)
        flat = regex.findall(r"(?<!\p{L})(?:" + "|".join(ws) + r")(?!\p{L})", text)
        assert regex.findall(r"(?<!\p{L})(?:" + tree + r")(?!\p{L})", text) == flat and len(flat) >= len(ws)


def test_long_texts_of_many_names(spark):
    """Every name of a text of a megabyte is replaced, alone and after its title, one to one."""
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(rnd.randint(4, 9))).capitalize() for _ in range(40_000)})
    text = " ".join(f"Mr {n} and {n} went." for n in names)
    assert len(text) > 10**6
    start = time.monotonic()
    (row,) = rewritten(spark, [(1, text)])
    assert time.monotonic() - start < 120
    found = re.findall(r"Mr (\w+) and (\w+) went\.", row.text)
    assert len(found) == len(names) == len(set(found)) and all(a == b for a, b in found) and row.n_entities == 2 * len(names)
    assert not {a for a, _ in found} & set(names)


def test_no_python_in_the_plan(spark, capsys):
    surrogates.replaced(docs_frame(spark, PII), "key").explain("formatted")
    assert not re.search("EvalPython|MapIn|InPandas|InArrow", capsys.readouterr().out)


if __name__ == "__main__":
    pytest.main([__file__])
