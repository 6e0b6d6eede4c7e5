import random

from leafsift.operators import assembly, ranking
from leafsift.plans import assess

MATCH = "filename string, page int, paragraph int, likelihood double"


def flags(df):
    return {(r["filename"], r["page"], r["paragraph"]): r["predicted_text_class"] for r in df.collect()}


def test_best_page_cases(spark):
    rows = [
        ("limit", 1, 1, 0.6), ("limit", 2, 1, 0.2),                      # nothing above 0.6
        ("count", 1, 1, 0.99), ("count", 2, 1, 0.61), ("count", 2, 2, 0.7), ("count", 2, 3, 0.1),  # count beats likelihood
        ("tie", 3, 1, 0.8), ("tie", 4, 1, 0.9),                          # tie on count: likelihood
        ("full", 9, 1, 0.9), ("full", 7, 1, 0.9),                        # full tie: lowest page
    ]
    got = flags(ranking.flag_best_page(spark.createDataFrame(rows, MATCH)))
    assert {k for k, v in got.items() if v} == {("count", 2, 1), ("count", 2, 2), ("tie", 4, 1), ("full", 7, 1)}
    assert len(got) == len(rows)


def test_best_page_random_equals_restatement(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 20)}", rng.randint(1, 4), i, rng.randint(0, 10) / 10) for i in range(400)]
    got = flags(ranking.flag_best_page(spark.createDataFrame(rows, MATCH)))
    for report in {r[0] for r in rows}:
        sure = [r for r in rows if r[0] == report and r[3] > 0.6]
        pages = {r[1] for r in sure}
        best = max(pages, key=lambda p: (sum(r[1] == p for r in sure), max(r[3] for r in sure if r[1] == p), -p), default=None)
        assert {k for k, v in got.items() if v and k[0] == report} == {(r[0], r[1], r[2]) for r in sure if r[1] == best}


def test_frequent_pages_keep_ties(spark):
    rows = [("a", 1, 1, 0.0), ("a", 1, 2, 0.0), ("a", 2, 1, 0.0), ("a", 2, 2, 0.0), ("a", 3, 1, 0.0), ("one", 5, 1, 0.0)]
    got = flags(ranking.flag_frequent_pages(spark.createDataFrame(rows, MATCH)))
    assert {k for k, v in got.items() if not v} == {("a", 3, 1)}


def flagged(spark, rows):
    return spark.createDataFrame(
        [(f, f.upper(), "2020", "ltifr", p, q, f"t{p}.{q}", c) for f, p, q, c in rows],
        "filename string, name string, year string, metric string, page int, paragraph int, text string, predicted_text_class int")


def test_assembly(spark):
    rows = [("a", 2, 1, 1), ("a", 1, 9, 1), ("a", 2, 3, 1), ("a", 2, 2, 0), ("b", 1, 1, 0)]
    reports = spark.createDataFrame([(f, f.upper(), "2020") for f in "abc"], "filename string, name string, year string")
    out = {r["filename"]: r for r in assembly.assemble(reports, flagged(spark, rows), ["ltifr"]).collect()}
    assert (out["a"]["class"], out["a"]["predicted_page"], out["a"]["predicted_text"]) == (1, [1, 2, 2], ["t1.9", "t2.1", "t2.3"])
    assert [(out[f]["class"], out[f]["predicted_page"], out[f]["predicted_text"]) for f in "bc"] == [(0, [], [])] * 2
    classes = {r["filename"]: r["class"] for r in assembly.report_classes(flagged(spark, rows)).collect()}
    assert classes == {"a": 1, "b": 0}


def test_long_lists_go_on_in_parts(spark):
    rows = [("hot", p, q, 1) for p in range(1, 40) for q in range(1, 30)] + [("cold", 1, 1, 1)]
    parts = assembly.collect_parts(flagged(spark, rows), 100).filter("filename = 'hot'").orderBy("part").collect()
    assert [r["part"] for r in parts] == list(range(12))
    assert all(len(r["predicted_page"]) == len(r["predicted_text"]) <= 100 for r in parts)
    assert [t for r in parts for t in r["predicted_text"]] == [f"t{p}.{q}" for _, p, q, _ in rows[:-1]]


def test_assess_ltifr_end_to_end(make_blocks):
    blocks = make_blocks({
        "Big_Co_Annual_Report_2020.pdf": {3: ["Our LTIFR was 1.2", "ltifr fell"], 5: ["LTIFR again"]},
        "Small_Annual_Report_2019.pdf": {1: ["Nothing here"]},
    })
    rows = {r["name"]: r for r in assess.assess_metric(blocks, "ltifr").collect()}
    assert rows["Big Co"]["predicted_page"] == [3, 3] and rows["Big Co"]["year"] == "2020"
    assert rows["Small"]["class"] == 0 and rows["Small"]["predicted_text"] == []
    one = assess.assess_report(blocks, "Big_Co_Annual_Report_2020.pdf", "ltifr").collect()
    assert [r["class"] for r in one] == [1]
