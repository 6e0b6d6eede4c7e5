import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsift.llm import hard_negatives, lexical, substrings

from . import brute
from .conftest import LONG


def passages(odd_rows):
    """Documents with exact copies, shared passages, passages twice in one document, and periodic text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    shared, whole = [text(n) for n in (19, 20, 21, 45, 200)], text(300)
    rows = [(100 + i, f"{text(30)} {shared[i % 5]}\n{text(10)}\t{shared[(i + 2) % 5]} {text(5)}") for i in range(40)]
    rows += [(300 + i, whole) for i in range(12)] + [(200, shared[3]), (201, shared[4] + "  " + shared[4]), (202, "a b " * 80), (203, "b a " * 50)]
    rows += [(204, shared[1].replace(" ", " ")), (202, "a b " * 60), (205, text(18)), (None, whole), (206, whole.upper())]
    return rows + [r[:2] for r in odd_rows]


@pytest.mark.parametrize("most, sample", [(substrings.MOST, substrings.SAMPLE), (0, 4096), (20_000, 0)])
def test_repeated_windows(make_docs, odd_rows, most, sample):
    rows = passages(odd_rows)
    out = substrings.without_repeated_windows(make_docs(rows), 20, most, sample)
    assert out.columns == ["doc_id", "n_words", "n_removed", "text"]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=repr)
    assert got == sorted(brute.repeated_windows(rows), key=repr)
    assert sum(r[2] for r in got) > 59_000  # the periodic text and the copies


def test_chunks_of_any_size_give_the_same_removals():
    rows = passages([])
    want = {i: r for i, r in enumerate(brute.repeated_windows(rows))}
    for size in (1, 700, 10**6):
        docs = [((i is None, i or 0, n), t) for n, (i, t) in enumerate(rows)]  # the row's number in place of the hash
        chunk, blobs = substrings.Chunk(20, 7, np.zeros(0, np.uint64)), []
        for doc, text in docs:
            chunk.add(doc, 0, text.encode().split())
            if chunk.size > size:
                blobs += list(chunk.blobs())
        blobs += list(chunk.blobs())
        gone = {}
        held = {b: substrings.Bucket(20) for b, _, _ in blobs}
        places = []
        for b, blob, n in blobs:
            columns, again, text = substrings.read_blob(substrings.pa.decompress(blob, n, "zstd", asbytes=True))
            held[b].add(columns, text)
            places += [(tuple(p), n) for *p, n in zip(*(c.tolist() for c in again))]
        for bucket in held.values():
            places += list(bucket.repeats())
        for (_, _, start, row), n in places:
            gone.setdefault(row, set()).update(range(start, start + n + 19))
        # Rows 202 share an id, where the brute force goes by the text's hash; all others must agree.
        assert all(len(gone.get(i, ())) == want[i][2] for i in want if want[i][0] != 202)


def test_pieces_of_a_long_text_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    for text in (" ".join(str(i) for i in range(900)), "x" * 1000 + " y" * 700, "a" * 2000, " " * 1000 + "b c"):
        words, windows = text.encode().split(), []
        for start, piece in substrings._pieces(text, 20):
            windows += [(start + i, tuple(piece[i : i + 20])) for i in range(len(piece) - 19)]
        assert windows == [(i, tuple(words[i : i + 20])) for i in range(len(words) - 19)]


def test_minimisers_depend_on_the_window_alone():
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b", b"cc"]) for _ in range(400)]
    hashes = substrings.Words().hashes(words)
    runs = substrings.runs_of_words(hashes)
    for frequent in (np.zeros(0, np.uint64), np.unique(runs)[:5]):
        least = substrings.least_places(runs, frequent, 16)
        by = {}
        for i in range(len(words) - 19):
            by.setdefault(b" ".join(words[i : i + 20]), set()).add((int(runs[least[i]]), int(least[i]) - i))
            assert 0 <= least[i] - i < 16
        assert all(len(v) == 1 for v in by.values())


def test_repeated_windows_of_odd_tables(make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    assert substrings.without_repeated_windows(docs.limit(0)).count() == 0
    assert [(r.n_words, r.n_removed) for r in substrings.without_repeated_windows(docs).orderBy("doc_id").collect()] == [(3, 0), (0, 0)]
    with pytest.raises(ValueError):
        substrings.without_repeated_windows(docs, 3)


def corpus(odd_rows):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(80)] + ["the"] * 40 + ["Über", "naïve", "x9"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    return rows + [(500 + i, "the T1-t2, (t3)") for i in range(30)] + [(i + 1000, t) for i, t, *_ in odd_rows if i is not None] + [(None, "t1 the")]


@pytest.mark.parametrize("terms, block, k", [(lexical.PASS_TERMS, lexical.BLOCK, 20), (12, 200, 5)])
def test_ranked_documents(spark, make_docs, odd_rows, monkeypatch, terms, block, k):
    rows = corpus(odd_rows)
    items = [("a", "the t1 t2 t3 t3 the"), ("b", "Über NAÏVE x9"), ("c", "nowhere"), ("d", None), (None, "t5 t6 t7"), ("e", " ,, "), ("f", "the"),
             ("g", " ".join(f"t{i}" for i in range(50))), ("h", "word one 1234")]
    monkeypatch.setattr(lexical, "PASS_TERMS", terms)
    table = spark.createDataFrame([*items, items[0]], "item_id string, text string").selectExpr("*", "1 AS rank", "2 AS doc_id", "3 AS n")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(make_docs(rows), table, k, block).collect()]
    assert sorted(got, key=repr) == sorted(brute.ranked(rows, items, k), key=repr)


def test_ranked_documents_of_odd_tables(spark, make_docs):
    docs, items = make_docs([(1, "a b"), (2, "")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0 and lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(make_docs([(1, None), (2, " ")]), items).count() == 0
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1)]
    two = spark.createDataFrame([(7, "a"), (7, "b")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, two).collect()] == [(7, 1, 1), (7, 1, 1)]


def test_terms_of_long_texts_are_not_cut():
    text = "ab cd-" * 400_000 + "é" * 50 + LONG
    assert [w for run in lexical.terms_of(text) for w in run] == text.encode().translate(lexical.TERM_BYTES).split()
    assert len(list(lexical.terms_of("x" * 3_000_000))) == 1


def test_best_positions_stop_early():
    """With falling impacts the lists are left long before their ends, and nothing of the best is lost."""
    rng = np.random.default_rng(0)
    docs, terms = 20_000, 3
    tf = np.ones((docs, terms), np.int64)
    tf[rng.permutation(docs)[:50]] += rng.integers(50, 900, (50, 1))
    starts = np.arange(docs + 1) * terms
    impacts = lexical.impact(tf.ravel(), np.repeat(rng.integers(3, 2000, docs), terms), docs, docs * 100)
    lists = lexical.Lists(np.arange(docs), starts, np.tile(np.arange(terms), docs), impacts, terms)
    item = lexical.Item(0, np.arange(terms), np.array([5, 3, 9]))
    best = lexical.Best(10)
    looked = lexical.best_positions(lists, item, np.zeros(terms, np.int64), np.zeros(terms, np.int64), best, np.zeros(docs, bool))
    scores = (impacts.reshape(docs, terms) * item.weights).sum(axis=1)
    want = sorted(range(docs), key=lambda d: (-scores[d], d))[:10]
    assert best.ids.tolist() == want and looked < docs / 10


@pytest.mark.parametrize("per_pass, block", [(1 << 15, 1024), (3, 16)])
def test_hard_negatives(spark, per_pass, block):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=12)
    rows = [(i, int(rng.integers(0, 4)), [float(np.float32(v)) for v in centre + 0.4 * rng.normal(size=12)]) for i in range(260)]
    rows[20:40] = [(i, y, rows[3][2]) for i, y, _ in rows[20:40]]  # ties
    rows += [(300, 1, None), (350, None, rows[0][2]), (400, 1, [1.0, None] + [0.0] * 10), (450, 2, [float("nan")] * 12), (500, 0, [float("inf")] * 12),
             (None, 1, rows[0][2]), (550, 1, [1.0, 1.0]), (551, 1, [2.0, 1.0]), (552, 2, [0.9, 1.2]), (600, 1, []), (601, 2, []), rows[7], rows[50], (100, 2, rows[9][2])]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows], "vec_id long, label int, embedding array<float>, anchor string, found int")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, anchors_per_pass=per_pass, block=block).collect()]
    assert sorted(got) == sorted(brute.mined(rows)) and len(got) > 50
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("width, most", [(64, 150), (3, 5), (5000, 100), (64, 2**20), (1, 1), (9000, 2**18)])
def test_residue_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a = hard_negatives.Anchors(np.arange(7), np.arange(7), np.zeros(7, int), rng.integers(-most, most + 1, (7, width)))
    x = np.concatenate([rng.integers(-most, most + 1, (9, width)), np.full((1, width), most), np.full((1, width), -most)])
    assert (a.scores(x) == a.v @ x.T).all()
    primes = hard_negatives.moduli(width, width * most * most)
    assert all(p % d for p in primes for d in range(2, int(p**0.5) + 1)) and np.prod([float(p) for p in primes]) > 2 * width * most * most
    assert all(min(width, hard_negatives.STRIP) * (p // 2) ** 2 < hard_negatives.EXACT for p in primes)


def test_scores_beyond_the_bound_raise():
    with pytest.raises(ValueError):
        hard_negatives.moduli(64, 1 << 55)
