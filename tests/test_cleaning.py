import random

from leafsift.functions.text import round_significant
from leafsift.operators import cleaning as c
from pyspark.sql import functions as F
from restated import cleaned, stitched, table_like

EDGE = {
    "Hits_Annual_Report_1.pdf": {1: ["a\n1b\n1c\n1", "a\n1b\n1c\n1d\n1", "gap", "x \n \n ", " \n  \n  \n 1", "e\né f\né g\né h\né",
                                     "a \n 1 \n 2 \n 3"]},
    "Two_Annual_Report_2.pdf": {1: ["A\n1\n2\n3\n4\nB", "C\n1\n2\n3\n4\n", "text", "D \n1\n2\n3\n4\n5"], 2: ["E\n1\n2\n3\n4\n"]},
    "Chain_Annual_Report_3.pdf": {1: ["A\n1\n2\n3\n4", " \n \n \n \n \n \n ", "B\n1\n2\n3\n4", "end"], 2: ["Z\n9\n8\n7\n6"]},
    "None_Annual_Report_4.pdf": {1: ["plain", "", "  ", "\t \n", "<image: x", "y.indd", "bad \ufffd", "\uf0b7 b", "2019 – 2020",
                                     "smile \U0001F600 done", "<TABLE fake"]},
    "Dash_Annual_Report_5.pdf": {1: ["Year – now\n1\n2\n3\n4\n", "mid"], 3: ["W\n1\n2\n3\n4\n"]},
    "Words_Annual_Report_6.pdf": {1: [" lead\nKeep me \n12\n34\n56\n78\nété\n\n", "mid"], 2: ["T\n1\n2\n3\n4"]},
}


def report_rows(pages):
    return [(p, i, t) for p, texts in pages.items() for i, t in enumerate(texts, 1)]


def by_report(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["filename"], []).append((r["page"], r["paragraph"], r["text"]))
    return {k: sorted(v) for k, v in out.items()}


def check_all(make_blocks, reports):
    blocks = make_blocks(reports)
    for contents in (True, False):
        for keep in (False, True):
            want = {f: cleaned(report_rows(p), contents, keep) for f, p in reports.items()}
            got = by_report(c.clean_blocks(blocks, contents, keep))
            assert got == {f: r for f, r in want.items() if r}
    got = {}
    for r in c.stitch_tables(blocks).orderBy("filename", "table_no").collect():
        got.setdefault(r["filename"], []).append((r["page"], r["paragraph"], r["raw_table_text"]))
    want = {f: [(p, q[0], t) for p, q, t in stitched(report_rows(pages))] for f, pages in reports.items()}
    assert got == {f: t for f, t in want.items() if t}


def test_edge_cases(make_blocks):
    check_all(make_blocks, EDGE)


def test_random_reports(make_blocks):
    rng = random.Random(7)
    bits = ["a", "B7", " ", "\n", "\n1", "\n \n", "12", "é", "–", "word\n", "3\n4\n5\n6\n"]
    reports = {
        f"R{n}_Annual_Report_2020.pdf": {
            p: ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(rng.randint(1, 6))] for p in range(1, 4)
        } for n in range(40)
    }
    check_all(make_blocks, reports)


def test_huge_page_is_numbered_across_cells(spark):
    """One report holds most rows, on one page and over many pages, past the cell sizes."""
    rows = [("Hot_Annual_Report_1.pdf", 1, i, "T\n1\n2\n3\n4\n" if i % 1500 else "stop") for i in range(1, 4000)]
    rows += [("Hot_Annual_Report_1.pdf", p, 5, "P\n1\n2\n3\n4\n") for p in range(2, 2500)]
    rows += [("Cold_Annual_Report_1.pdf", 1, 1, "T\n1\n2\n3\n4\n")]
    blocks = spark.createDataFrame(rows, "filename string, page int, paragraph int, text string")
    hot = sorted(r[1:] for r in rows if r[0].startswith("Hot"))
    numbers = {(r["page"], r["paragraph"]): r["table_no"] for r in c.find_tables(blocks).filter("filename like 'Hot%'").collect()}
    assert numbers == {(p, q): n for n, (p, q, _) in enumerate([t for t in hot if table_like(t[2])], 1)}
    starts = [(r["page"], r["paragraph"]) for r in c.stitch_tables(blocks).filter("filename like 'Hot%'").orderBy("table_no").collect()]
    assert starts == [(p, q[0]) for p, q, _ in stitched(hot)]


def test_audit_and_counts(make_blocks):
    blocks = make_blocks({"A": {1: ["a\ufffdb", "c d\n"]}, "B": {1: ["", "  "]}})
    got = {r["filename"]: r for r in c.audit_characters(blocks).collect()}
    assert (got["A"]["n_bad"], got["A"]["n_chars"]) == (1, 6)
    assert got["A"]["pct_bad_short"] == 17.0
    assert got["B"]["pct_bad"] is None
    assert {r["filename"]: r["n"] for r in c.count_characters(blocks, "[a-c]").collect()} == {"A": 3, "B": 0}


def test_round_significant(spark):
    values = [12345.0, 0.0123456, -987.6, 2.5, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(round_significant("x", 2)).collect()]
    assert got == [12000.0, 0.012, -990.0, 2.5, None]


def test_table_cells(spark):
    rows = [("r", 1, "Sales\nCost\nUK\n1\n2\nFR\n3\n4\n"), ("r", 2, "Head\nUK\n1\nFR\n"), ("r", 3, "single"), ("r", 4, "one\ntwo\nthree\n")]
    cells = c.table_cells(spark.createDataFrame(rows, "filename string, table_no int, raw_table_text string"))
    got = {}
    for r in cells.orderBy("table_no", "row_no", "col_no").collect():
        got.setdefault(r["table_no"], []).append((r["row_no"], r["col_no"], r["header"], r["value"], r["is_ragged"]))
    assert [g[:4] for g in got[1]] == [(0, 0, "Index", "UK"), (0, 1, "Sales", "1"), (0, 2, "Cost", "2"),
                                       (1, 0, "Index", "FR"), (1, 1, "Sales", "3"), (1, 2, "Cost", "4")]
    assert not any(g[4] for g in got[1])
    assert 3 not in got and got[2][-1][4]
    assert [g[3] for g in got[4]] == ["two", "three"]  # no numeric entry: all but the last break are headers


def test_empty_pages_are_kept(make_blocks):
    blocks = make_blocks({"A": {1: ["<image: x"], 2: ["text"]}})
    got = {r["page"]: (r["n_before"], r["n_after"]) for r in c.pages_after_cleaning(blocks, c.clean_blocks(blocks)).collect()}
    assert got == {1: (1, 0), 2: (1, 1)}


def test_cleaning_adds_no_blocks_and_does_not_shuffle_text(make_blocks):
    blocks = make_blocks(EDGE)
    assert c.clean_blocks(blocks).count() <= blocks.count()
    plan = c.clean_blocks(blocks, table_contents=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert c.normalise(blocks).filter(F.col("text").rlike("[^ -~]")).count() == 0
