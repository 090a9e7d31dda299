"""The PDF source: a report written by hand in old and new file forms, damaged files, and the quality of what is read."""

import io
import re
import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from proofloom.operators import layout, pages
from proofloom.sources import pdf
from report import LINES, TABLES

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def wrapped(text, size):
    most, out = int(451 / (size * 0.5)), [""]
    for w in text.split():
        out = [*out[:-1], (out[-1] + " " + w).strip()] if len(out[-1]) + len(w) < most else [*out, w]
    return out


def drawing(p):
    """Operators of a page of the report; tables are ruled by lines, or on page 5 by boxes."""
    out = ["q 0 0 0 RG 0.7 w"]
    text = lambda x, y, font, size, t: out.append(f"BT /{font} {size} Tf {x} {842 - y} Td ({t.replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj ET")
    for t, size, bold, y in LINES[p]:
        lines = wrapped(t, size)
        if len(lines) == 1:
            text(72, y, "B" if bold else "R", size, t)
        else:  # a paragraph, line by line, some of it in pieces
            out.append(f"BT /R {size} Tf {size * 1.3} TL 72 {842 - y} Td")
            for line in lines:
                a, _, b = line.partition(" ")
                esc = lambda x: x.replace("(", "\\(").replace(")", "\\)")
                out.append(f"[({esc(a)}) -278 ({esc(b)})] TJ T*")
            out.append("ET")
    if rows := TABLES.get(p):
        top, xs = 184, [72, 320, 410, 500]
        for i, r in enumerate(rows):
            for j, c in enumerate(r):
                text(xs[j] + 6, top + 22 * i + 15, "B" if i == 0 else "R", 10, c)
        bottom = top + 22 * len(rows)
        if p == 5:
            out += [f"{xs[j]} {842 - top - 22 * (i + 1)} {xs[j + 1] - xs[j]} 22 re S" for i in range(len(rows)) for j in range(3)]
        else:
            out += [f"{xs[0]} {842 - top - 22 * i} m {xs[-1]} {842 - top - 22 * i} l S" for i in range(len(rows) + 1)]
            out += [f"{x} {842 - top} m {x} {842 - bottom} l S" for x in xs]
    if p == 1:
        out += ["q 80 0 0 120 300 300 cm /Im Do Q", "q 1 0 0 1 10 20 cm /Fm Do Q"]
    text(500, 805, "R", 9, f"Page {p}")
    return "\n".join([*out, "Q"]).encode()


def stream(data, more=b"", squeeze=True):
    data = zlib.compress(data) if squeeze else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if squeeze else b"", more, data)


def objects():
    fonts = b"/Font << /R 3 0 R /B << /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [39 /quotesingle] >> >> >>"
    out = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count 6 /Kids [5 0 R 4 0 R] /MediaBox [0 0 595 842] /Resources << %s /XObject << /Im 20 0 R /Fm 21 0 R >> >> >>" % fonts,
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        4: b"<< /Type /Pages /Parent 2 0 R /Count 4 /Kids [12 0 R 13 0 R 14 0 R 15 0 R] >>",
        5: b"<< /Type /Pages /Parent 2 0 R /Count 2 /Kids [10 0 R 11 0 R] >>",
        20: stream(bytes(12), b"/Type /XObject /Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8"),
        21: stream(b"BT /R 8 Tf 100 100 Td (inside a form) Tj ET", b"/Type /XObject /Subtype /Form /BBox [0 0 400 400]"),
    }
    for k in range(6):
        out[10 + k] = b"<< /Type /Page /Parent %d 0 R /Contents %s >>" % (5 if k < 2 else 4, b"[%d 0 R %d 0 R]" % (30 + k, 40 + k) if k % 2 else b"%d 0 R" % (30 + k))
        data = drawing(k + 1)
        cut = data.index(b"\n", len(data) // 2) if k % 2 else len(data)
        out[30 + k] = stream(data[:cut])
        if k % 2:
            out[40 + k] = stream(data[cut:], squeeze=False)
    return out


def old_form(objs, trailer=b"", comment=b""):
    out, where = io.BytesIO(), {}
    out.write(b"%PDF-1.4\n%" + b"\xe2\xe3\xcf\xd3\n" + comment)
    for n, o in objs.items():
        where[n] = out.tell()
        out.write(b"%d 0 obj\n%s\nendobj\n" % (n, o))
    at = out.tell()
    out.write(b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in where.items()))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (max(objs) + 1, trailer, at))
    return out.getvalue()


def new_form(objs):
    """Plain objects in an object stream, and a cross-reference stream with row filters."""
    plain = {n: o for n, o in objs.items() if not o.endswith(b"endstream")}
    heads, body = [], b""
    for n, o in plain.items():
        heads += [n, len(body)]
        body += o + b" "
    first = " ".join(map(str, heads)).encode() + b" "
    objs = {n: o for n, o in objs.items() if n not in plain} | {50: stream(first + body, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(first)))}
    out, where = io.BytesIO(), {}
    out.write(b"%PDF-1.5\n")
    for n, o in objs.items():
        where[n] = out.tell()
        out.write(b"%d 0 obj\n%s\nendobj\n" % (n, o))
    at, rows = out.tell(), []
    for n in range(52):
        rows.append(bytes([1]) + where[n].to_bytes(3, "big") + b"\0" if n in where else bytes([2]) + (50).to_bytes(3, "big") + bytes([list(plain).index(n)]) if n in plain else bytes([1]) + at.to_bytes(3, "big") + b"\0" if n == 51 else bytes(5))
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, p)) for r, p in zip(rows, [bytes(5), *rows]))
    out.write(b"51 0 obj\n" + stream(up, b"/Type /XRef /W [1 3 1] /Size 52 /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 5 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, objs = tmp_path_factory.mktemp("pdf"), objects()
    good = old_form(objs)
    (d / "old.pdf").write_bytes(good)
    (d / "sub").mkdir()
    (d / "sub" / "new.PDF").write_bytes(new_form(objs))
    (d / "damaged.pdf").write_bytes(good[: good.rindex(b"xref\n0 1")].replace(b"endstream\nendobj\n30", b"endstream\nendobj\n\n\n30"))
    (d / "bent.pdf").write_bytes(good.replace(b"startxref\n", b"startxref\n9"))
    (d / "encrypted.pdf").write_bytes(old_form(objs, b"/Encrypt << /Filter /Standard >>"))
    (d / "empty.pdf").write_bytes(old_form(objs | {2: b"<< /Type /Pages /Count 0 /Kids [] >>"}))
    (d / "nothing.pdf").write_bytes(b"")
    (d / "noise.pdf").write_bytes(bytes(range(256)) * 40)
    (d / "page.pdf").write_bytes(old_form(objs | {32: stream(b"", b"/Filter /LZWDecode", squeeze=False)}))
    (d / "loop.pdf").write_bytes(old_form(objs | {4: b"<< /Type /Pages /Kids [2 0 R 4 0 R 12 0 R] >>"}))
    (d / "notes.txt").write_text("no pdf")
    return d


@pytest.fixture(scope="module")
def rows(spark, folder, tmp_path_factory):
    pdf.register(spark)
    out = f"file://{tmp_path_factory.mktemp('pdfrows')}/rows"
    spark.read.format("pdf").load(f"file://{folder}").withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1)).write.parquet(out)
    return spark.read.parquet(out)


def test_errors_are_rows(rows):
    got = {(r.doc_id, r.page): r.error for r in pdf.errors(rows).collect()}
    assert {k for k, p in got if p is None} == {"encrypted.pdf", "empty.pdf", "nothing.pdf", "noise.pdf"}
    assert "encrypted" in got["encrypted.pdf", None] and "no pages" in got["empty.pdf", None]
    assert [k for k in got if k[1]] == [("page.pdf", 3)], "one page that can't be drawn leaves the others"
    n = {r.doc_id: r["count"] for r in rows.filter("kind = 'page'").groupBy("doc_id").count().collect()}
    assert n == {"old.pdf": 6, "new.PDF": 6, "damaged.pdf": 6, "bent.pdf": 6, "page.pdf": 6, "loop.pdf": 3}


def test_all_forms_tell_the_same(rows):
    of = lambda d: sorted(tuple(r) for r in rows.filter(F.col("doc_id") == d).drop("doc_id").collect())
    assert of("old.pdf") == of("new.PDF") == of("damaged.pdf") == of("bent.pdf")


def test_report_blocks(spark, rows):
    own = rows.filter("doc_id = 'new.PDF'")
    got = pages.extract(*pdf.tables_of(own)).collect()
    by = lambda p, kind=None: [r.content for r in sorted((r for r in got if r.page == p), key=lambda r: r.block_id) if kind in (None, r.type)]
    for p, lines in LINES.items():
        for text, size, bold, _ in lines:
            found = [c for c in by(p) if " ".join(c.split()) == text]
            assert len(found) == 1, (p, text, by(p))
            assert (found[0] in by(p, "title")) == (size > 11 and len(text) <= 90), text
        assert [c for c in by(p, "footer")] == [f"Page {p}"]
    for p, cells in TABLES.items():
        assert by(p, "table") == ["\n".join("| " + " | ".join(r) + " |" for r in cells)]
        assert not any(c in ("6,303", "Net assets") for c in by(p, "text"))
    assert by(1, "figure") == [""] and "inside a form" in by(1)
    order = [r.content for r in sorted((r for r in got if r.page == 4 and r.ord is not None), key=lambda r: r.ord)]
    assert order[0] == "Consolidated Income Statement" and order[-1].startswith("| Segment")
    assert layout.mark_furniture(pages.extract(*pdf.tables_of(own)).withColumn("seq", F.col("block_id"))).filter("type = 'footer'").count() == 6


def test_shares_of_a_file(spark, folder):
    pdf.register(spark)
    read = lambda **o: spark.read.format("pdf").options(**o).load(f"file://{folder}/old.pdf")
    whole, parts = read(), read(split=500)
    assert parts.rdd.getNumPartitions() > 6 > whole.rdd.getNumPartitions()
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert spark.read.format("pdf").load(f"file://{folder}/sub").filter("kind = 'page'").count() == 6


def test_files_of_any_store(spark, folder, rows):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(f"file://{folder}")
    got = pdf.from_files(files).withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.filter("doc_id not in ('new.PDF', 'nothing.pdf')").collect()), key=str)
    # Spark lists no empty files
    none = pdf.from_files(spark.createDataFrame([("a", None)], "path string, content binary")).collect()
    assert [(r.doc_id, r.kind) for r in none] == [("a", "error")]


def test_reads_ranges_of_bytes(folder):
    class Counted(io.BytesIO):
        n = 0

        def read(self, k=-1):
            self.n += len(out := super().read(k))
            return out

    big = old_form(objects() | {60 + k: stream(bytes(range(256)) * 400, squeeze=False) for k in range(40)})
    f = Counted(big)
    assert sum(r[2] == "page" for r in pdf.rows_of(f, len(big), "x", 0, 6)) == 1
    assert f.n < len(big) / 5


def test_strings_and_fonts():
    lex = pdf.Lexer(b"(a\\(b\\)(c)\\n\\101\\\r\nd) <4142 4> /A#20B [1 -2.5 .5 3 0 R true null] % x\n<< /K (v) /L << /M 1 >> >> Tj")
    assert lex.next() == b"a(b)(c)\nAd" and lex.next() == b"AB@" and lex.next() == "A B"
    assert lex.next() == [1, -2.5, 0.5, pdf.Ref(3), True, None] and lex.next() == {"K": b"v", "L": {"M": 1}} and lex.next() == pdf.Keyword(b"Tj") and lex.next() is pdf.END
    single, ranges = pdf.unicode_map(b"2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0066 0069> <0078>] endbfrange")
    assert single == {1: "A", 2: "😀"} and ranges == [(16, 18, b"\x00a"), (32, 33, ["fi", "x"])]
    assert [pdf.glyph(g) for g in ("A", "eacute", "udieresis", "uni20AC", "fi", "period.alt", "g123")] == ["A", "é", "ü", "€", "fi", ".", ""]


def test_written_documents_read_back(spark):
    texts = ["", None, "One line, naïve “quotes” and 😀 Ελληνικά.", "\n".join(f"Line {k} " + "word " * (k % 40) for k in range(300)), "x" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pdf.from_files(pdf.render(docs))
    got = {int(r.doc_id): r for r in rows.filter("kind <> 'page'").groupBy("doc_id").agg(F.collect_list(F.struct("page", "seq", "text")).alias("t"), F.count_if(F.col("kind") == "error").alias("e")).collect()}
    for k, t in enumerate(texts):
        words = " ".join(x.text for x in sorted(got[k].t)).split() if k in got else []
        assert ("".join(words) if k == 4 else " ".join(words)) == " ".join((t or "").split()), k
    assert rows.filter("kind = 'error'").count() == 0 and rows.filter("kind = 'page' and doc_id = 3").count() > 6


def test_a_map_of_codes_is_read_once(monkeypatch):
    """Files with the same map, as all written here: a task reads it for the first; what is told of each file stays its own."""
    read, one = [], pdf.unicode_map
    monkeypatch.setattr(pdf, "unicode_map", lambda data: read.append(1) or one(data))
    monkeypatch.setattr(pdf, "_MAPS", {})
    for k in range(5):
        text = f"{k} Grüße \U0001f600 日本 " + "x" * 300
        data = pdf.rendered(text)
        rows = list(pdf.rows_of(io.BytesIO(data), len(data), "f"))
        assert "".join(r[4] for r in rows if r[2] == "span").replace(" ", "") == text.replace(" ", "")
    assert len(read) == 1


def test_blanks_at_cuts_alone_are_lost():
    odd = ["", "   ", "a" * 25, "aa " * 9 + "b" * 30 + " c", "  x" * 20, "x   y \x1f z" * 5, "  lead\ttab\x0b\x0c\rend  "]
    for line in odd:
        parts = pdf._wrapped(line, 10)
        assert all(len(p) <= 10 for p in parts) and parts
        assert re.sub("[\t-\r ]", "", "".join(parts)) == re.sub("[\t-\r ]", "", line)


def test_one_row_group_is_written_in_many_tasks(spark):
    few = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    assert pdf.render(few).select(F.spark_partition_id()).distinct().count() > 1
