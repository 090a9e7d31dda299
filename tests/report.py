"""A six-page report and questions about it, as tables: what a parser would tell of its pages. Fixed values."""

LINES = {
    1: [("ACME PLC", 22, 1, 90), ("Annual Report and Accounts", 11, 0, 130), ("January 2026", 11, 0, 160)],
    2: [
        ("Chairman's Statement", 22, 1, 90),
        ("I am pleased to report another year of progress for the Group. Trading conditions remained challenging, yet the business delivered resilient results, driven by disciplined cost control and continued investment in our online platform.", 11, 0, 130),
        ("The Board is recommending a final dividend of 75 pence per share, bringing the total dividend for the year to 140 pence, an increase of 6% on the prior year.", 11, 0, 200),
    ],
    3: [
        ("Financial Review", 22, 1, 90),
        ("Group revenue increased by 5.9% to 6,303 million pounds, with full price sales up 7.1%. Operating margin improved to 16.7%, reflecting operational leverage and lower markdown activity during the period.", 11, 0, 130),
        ("Profit before tax was 1,011 million pounds, up 8.4% on the prior year. Earnings per share rose to 712 pence and the Group generated strong free cash flow.", 11, 0, 200),
    ],
    4: [("Consolidated Income Statement", 22, 1, 90), ("The income statement for the 52 weeks to January 2026 is set out below.", 11, 0, 130), ("Income Statement (GBP m)", 13, 1, 170)],
    5: [("Consolidated Balance Sheet", 22, 1, 90), ("Net assets increased during the period as summarised below.", 11, 0, 130), ("Balance Sheet (GBP m)", 13, 1, 170)],
    6: [
        ("Notes to the Accounts", 22, 1, 90),
        ("Revenue is recognised when control of goods passes to the customer. The Group operates retail stores and an online platform across multiple territories.", 11, 0, 130),
        ("The effective tax rate for the year was 23.8%. Capital expenditure totalled 168 million pounds, primarily on warehouse automation and technology systems.", 11, 0, 200),
    ],
}
TABLES = {
    4: [["Segment", "FY26", "FY25"], ["Revenue", "6,303", "5,952"], ["Cost of sales", "(4,001)", "(3,820)"], ["Gross profit", "2,302", "2,132"], ["Operating profit", "1,052", "985"], ["Profit before tax", "1,011", "933"], ["Profit after tax", "770", "712"]],
    5: [["Item", "FY26", "FY25"], ["Non-current assets", "2,540", "2,410"], ["Current assets", "1,980", "1,850"], ["Total assets", "4,520", "4,260"], ["Total liabilities", "(3,090)", "(2,980)"], ["Net assets", "1,430", "1,280"]],
}
QUESTIONS = [
    ("What was total revenue in FY26?", [3, 4], "qa"), ("What was operating profit in FY26?", [4], "qa"), ("What were net assets at the period end?", [5], "qa"), ("What total dividend per share was recommended for the year?", [2], "qa"),
    ("What was profit before tax in FY26?", [3, 4], "qa"), ("What was the effective tax rate for the year?", [6], "qa"), ("How much was capital expenditure?", [6], "qa"), ("What was the operating margin?", [3], "qa"),
    ("What were total assets in FY26?", [5], "qa"), ("What was cost of sales in FY26?", [4], "qa"), ("What was profit after tax in FY26?", [4], "qa"), ("What were earnings per share?", [3], "qa"),
    ("By how much did revenue grow year on year?", [3], "calc"), ("What were current assets in FY26?", [5], "qa"), ("What was gross profit in FY26?", [4], "qa"), ("What was revenue in the prior year, FY25?", [4], "qa"),
    ("What were total liabilities in FY26?", [5], "qa"), ("What was profit before tax in the prior year, FY25?", [4], "qa"), ("By how much did net assets change year on year?", [5], "calc"),
    ("Did operating profit rise or fall versus the prior year, and by roughly how much?", [4], "calc"), ("Approximately what was the gross profit margin in FY26?", [4], "calc"),
    ("Who is the chief executive officer?", [], None), ("What was the company's share price at year end?", [], None), ("How many employees does the company have?", [], None), ("What is the company's carbon emissions reduction target?", [], None),
]


def page_tables(spark, doc_id=1):
    """(pages, spans, images, tables, strokes) of the report; the table cells stand as text below the tables as well."""
    spans, strokes, tables, pages = [], [], [], []
    for p, lines in LINES.items():
        rows = [(t, s, b, y, 72.0, 523.0, y + (12.0 if len(t) < 80 else 50.0)) for t, s, b, y in lines] + [(f"Page {p}", 9, 0, 796.0, 500.0, 530.0, 805.0)]
        rows += [(c, 10, 0, 190.0 + 22 * i, 80.0 + 120 * j, 180.0 + 120 * j, 200.0 + 22 * i) for i, r in enumerate(TABLES.get(p, [])) for j, c in enumerate(r)]
        for k, (text, size, bold, y0, x0, x1, y1) in enumerate(rows):
            spans.append((doc_id, p, k, 0, 0, text, float(size), "Helvetica-Bold" if bold else "Helvetica", 0, x0, float(y0), x1, float(y1)))
        if p in TABLES:
            content = "\n".join("| " + " | ".join(r) + " |" for r in TABLES[p])
            tables.append((doc_id, p, content, TABLES[p], 72.0, 184.0, 440.0, 190.0 + 22 * len(TABLES[p])))
            strokes += [(doc_id, p, "l")] * 6
        pages.append((doc_id, p, 595.0, 842.0, sum(len(r[0]) for r in rows)))
    return (
        spark.createDataFrame(pages, "doc_id long, page int, width double, height double, chars int"),
        spark.createDataFrame(spans, "doc_id long, page int, block int, line int, seq int, text string, size double, font string, flags int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame([(doc_id, 1, 90, 10.0, 300.0, 30.0, 320.0), (doc_id, 1, 91, 10.0, 300.0, 110.0, 420.0), (doc_id, 4, 90, 80.0, 190.0, 200.0, 300.0)], "doc_id long, page int, block int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(tables, "doc_id long, page int, content string, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(strokes, "doc_id long, page int, op string"),
    )


def report_chunks(spark, doc_id=1):
    from proofloom.operators import chunks, layout, pages
    from pyspark.sql import functions as F

    blocks = pages.extract(*page_tables(spark, doc_id)).withColumn("seq", F.col("block_id"))
    return chunks.chunks(layout.mark_furniture(blocks))
