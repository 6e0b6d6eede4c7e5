import duckdb
import pytest
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
# A quick sample; ``check.py`` compares all of them.
SAMPLE = ["s02_blocks_from_html", "c05_stitch_tables", "c11_clean_blocks", "p04_many_metrics", "m04_phrase_match_ltifr",
          "r01_best_page", "t05_l2_weights", "t10_balanced", "t16_batch_scores", "h02_split", "a05_not_found_rows"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    rel = duck.execute(oracle_sql()[name])
    names = [c[0] for c in rel.description]
    want = sorted((tuple(r[names.index(c)] for c in order) for r in rel.fetchall()), key=repr)
    assert sorted(names) == order and got == want and got


def test_entry(spark):
    assert entry(spark).filter("class = 1").count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
