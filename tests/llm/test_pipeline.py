import random
from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tokenizers import Tokenizer

from leafsift.llm.queries import QUERIES

from . import brute
from .test_models_and_pages import TALK, talk

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" not in oracle_sql()


def test_stages_in_turn(spark, make_docs, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            assert 0 < out.count() <= docs.count()
            docs = out
        odd = make_docs(odd_rows)
        assert stage(spark, odd, SF).count() > 0 and stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 100


def planted():
    """Documents in two languages with letterless ones, template lines, copies, near copies and passages of two benchmark items."""
    rng = random.Random(31)
    words = TALK["en"].split()
    fresh = lambda n: " ".join(rng.choice(words) + ("" if rng.random() < 0.5 else f" {rng.choice(words)}ing") for _ in range(n))
    items = [(1, fresh(12)), (2, "zebra quilts jump"), (3, None)]
    rows = [(i, fresh(30), "en") for i in range(60)] + [(i, talk("de", 40, rng), "de") for i in range(60, 100)]
    rows += [(100 + i, f"{fresh(25)}\n Read MORE here\n{fresh(5)}", "en") for i in range(12)]
    rows += [(120 + i, text, "en") for i, text in enumerate(["1234 !!", "", None, "12\n34"])]
    rows += [(140 + i, rows[i][1], "en") for i in range(0, 20, 2)]  # exact copies
    rows += [(160 + i, rows[i][1].upper() + "\n\tread more here", "en") for i in range(10)]  # copies but for case and a template line
    rows += [(180 + i, f"{fresh(10)} {items[0][1].upper()}, {fresh(10)}", "en") for i in range(6)]
    rows += [(190, fresh(12) + " Zebra quilts, jump " + fresh(9), "en"), (191, fresh(20) + " zebra quilts " + fresh(9), "en")]
    rows += [(200, fresh(1_500), "en")]  # more than one sequence long
    rng.shuffle(rows)
    return [(i, t, lang, f"www.{lang}.example", len(t or "")) for i, t, lang in rows], items


def test_planted_cases_against_brute_force(spark, tmp_path):
    rows, items = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    docs = [(i, t) for i, _, _, t in brute.line_dedup(docs)]
    prints = {i: brute.fingerprint(t) for i, t in docs}
    root = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    docs = [(i, t) for i, t in docs if root[i] == i]
    dirty = {i for i, _, hit, _ in brute.contamination(docs, items) if hit}
    docs = {i: t for i, t in docs if i not in dirty}
    assert len(dirty) >= 7 and 191 in docs and 190 not in docs and len(rows) - len(docs) >= 30

    import public_tokenizers as files

    encode = Tokenizer.from_file(files.path("byte_bpe_50k.json")).encode
    sizes = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total, sequences = Counter(), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == total[r.doc_id]
        total[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == sizes
    for parts in sequences.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= 1024
    assert len(sequences) == brute.best_fit_bins([r.length for r in got], 1024)
    assert all(r.length == 1024 for r in got if r.doc_id == 200 and 0 < r.piece < max(p.piece for p in got if p.doc_id == 200))
