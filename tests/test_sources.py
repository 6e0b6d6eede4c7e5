import pytest
from leafsift.operators import linear, naive_bayes
from leafsift.plans import assess
from leafsift.sources import models, reports, tables
from pyspark.sql import functions as F


def test_scan_and_decode(spark, tmp_path):
    for name in ("A_Co_Annual_Report_2020.pdf", "B.PDF", "notes.txt"):
        (tmp_path / name).write_bytes(b"one|two\x0cthree")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "C_Annual_Report_2020.pdf").write_bytes(b"x")
    (tmp_path / "empty").mkdir()
    files = reports.scan_reports(spark, [str(tmp_path), str(tmp_path / "empty")])
    assert [r["path"].split("/")[-1] for r in files.select("path").collect()] == ["A_Co_Annual_Report_2020.pdf"]
    blocks = reports.decode_reports(files, lambda b: [page.split("|") for page in b.decode().split("\x0c")])
    assert sorted(tuple(r)[1:] for r in blocks.collect()) == [(1, 1, "one"), (1, 2, "two"), (2, 1, "three")]


def test_metadata(spark):
    paths = ["/x/Blue_Harbour_Annual_Report_2020.pdf", "/x/y/One_Annual_Report_2019.v2.pdf", "/x/nomark.pdf"]
    meta = reports.report_metadata(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(r["name"], r["year"], r["type"]) for r in reports.parsed_reports(meta).collect()}
    assert got == {("Blue Harbour", "2020", "Annual Report"), ("One", "2019", "Annual Report")}
    assert [r["filename"] for r in reports.quarantined_reports(meta).collect()] == ["nomark.pdf"]


def test_block_sources(spark):
    df = spark.createDataFrame([("f", "a\nb\n\nc\nd")], "f string, text string")
    got = [tuple(r) for r in reports.blocks_from_text(df, F.col("f"), blocks_per_page=2).orderBy("page", "paragraph").collect()]
    assert got == [("f", 1, 1, "a"), ("f", 1, 2, "b"), ("f", 2, 1, ""), ("f", 2, 2, "c"), ("f", 3, 1, "d")]
    html = spark.createDataFrame([("f", "<p>a &amp; b<script>var t='</p>'</script></p> <div>c<b>d</b></div><!-- x -->")], "f string, html string")
    assert [r["text"] for r in reports.blocks_from_html(html, F.col("f")).orderBy("page", "paragraph").collect()] == ["a & b", "cd"]


def test_labelled_csv_and_matches(spark, tmp_path, make_blocks):
    (tmp_path / "l.csv").write_text('text,class\n"two\nlines, ""q""",1\nplain,0\n')
    rows = tables.read_labelled(spark, str(tmp_path / "l.csv")).collect()
    assert [tuple(r) for r in rows] == [('two\nlines, "q"', 1), ("plain", 0)]
    blocks = make_blocks({"A_Annual_Report_1.pdf": {1: ["LTIFR 1"]}, "B_Annual_Report_1.pdf": {1: ["LTIFR 2"]}})
    candidates = assess.training_candidates(blocks, "ltifr", 1)
    for fmt in ("csv", "parquet"):
        tables.write_matches(candidates, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["filename"] == "A_Annual_Report_1.pdf"
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 1


def test_model_store(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1), ("c", 0)], "text string, class int")
    store = str(tmp_path / "store")
    with pytest.raises(ValueError):
        models.load_model(spark, store, "n_employees")
    first, second = (*naive_bayes.train(rows, 1.0), (1, 1)), (*naive_bayes.train(rows, 0.5, (1, 2)), (1, 2))
    assert [models.save_model(spark, store, "n_employees", m) for m in (first, second)] == [1, 2]
    # A write that broke off: tables without a row of the manifest.
    rows.write.parquet(f"{store}/models/broken/vocabulary")
    vocabulary, totals, ngram_range = models.load_model(spark, store, "n_employees")
    assert vocabulary.exceptAll(second[0]).isEmpty() and totals.first() == second[1].first() and ngram_range == (1, 2)
    assert models.load_model(spark, store, "n_employees", 1)[1].first() == first[1].first()
    linear_model = linear.train_linear(rows)
    assert models.save_model(spark, store, "healthcare", linear_model) == 1
    again = models.load_model(spark, store, "healthcare")
    assert again.bias == linear_model.bias and again.terms.exceptAll(linear_model.terms).isEmpty()
    assert again.predict(rows.withColumn("doc_id", F.col("class"))).filter("prediction = class").count() == 2
    with pytest.raises(ValueError):
        models.load_model(spark, store, "n_employees", 7)


def test_first_reports(make_blocks):
    blocks = make_blocks({n: {1: ["x", "y"]} for n in ("b", "a", "c")})
    assert sorted(r["filename"] for r in reports.first_reports(blocks, 2).collect()) == ["a", "a", "b", "b"]
