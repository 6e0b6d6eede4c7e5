import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsift.llm import packing, simhash, topk
from leafsift.llm.graph import components

from . import brute


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "Two words", "three WORDS here", "a b c d a b c", "É é x", "w " * 40_000, "x" * 100_000]
    assert [simhash.fingerprint(t) for t in texts] == [brute.fingerprint(t) for t in texts]
    row = spark.createDataFrame([(1, "a b c d a b c")], "doc_id long, text string")
    assert simhash.fingerprints(row).select(simhash.hex_fingerprint(F.col("fp"))).first()[0] == f"{brute.fingerprint(texts[6]):016x}"


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_pairs_of_fingerprints(spark, bits):
    rng = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 1, 2, 2, 3)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset((r.a, r.b)) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
    assert got == want and (want or not bits)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (-5, 300), (300, -7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, -5: -7, -7: -7, 300: -7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(odd_rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    long = [" ".join(rng.choices(words, k=3000)) for _ in range(3)]
    return odd_rows + [(30 + i, t + f" tail{i % 4}") for i in range(12) for t in long[: 1 + i % 3]] + [(20, long[0])] * 3


def test_near_duplicates(make_docs, odd_rows):
    rows = near_rows(odd_rows)
    prints = {(i, t): brute.fingerprint(t) for i, t, *_ in rows}
    nodes = set(prints.values())
    root = brute.groups(nodes, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, t), fp in prints.items():
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    docs = make_docs(rows)
    got = sorted(((r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()), key=repr)
    assert got == sorted(((i, prints[i, t], least.get(root[prints[i, t]])) for i, t, *_ in rows), key=repr)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(root.values())) and {i for i in ids if i is not None} == set(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (1, 7, 50, 1024):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))] + [min(3, capacity)] * 60
        histogram = {n: lengths.count(n) for n in set(lengths)}
        filled, ranks = {}, {n: 0 for n in histogram}
        for length, first, last, start, offset in packing.best_fit_plan(histogram, capacity):
            assert first == ranks[length]
            ranks[length] = last + 1
            for i in range(last - first + 1):
                assert filled.get(start + i, 0) == offset
                filled[start + i] = offset + length
        assert ranks == histogram and max(filled.values()) <= capacity
        assert len(filled) == brute.best_fit_bins(lengths, capacity)


def test_encoder_equals_the_reference_tokenizer():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    full, ours = Tokenizer.from_file(files.path("byte_bpe_50k.json")), packing.Encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(0)
    texts = ["", " ", "a  b \n\n c\t", "It's 12,5 %", "<|endoftext|> x", "été ñandú 😀 中文  　x", "x" * 3000, " " * 500 + "y"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(300)) for _ in range(40)]
    for text in texts:
        assert ours(text) == full.encode(text, add_special_tokens=False).ids, repr(text[:40])
    long = ("some words, and more!  12 " * 50_000)[:-1]
    parts = list(packing._parts(long))
    assert len(parts) > 1 and "".join(parts) == long and ours(long) == full.encode(long, add_special_tokens=False).ids


def test_packing(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    pieces = packing.token_pieces(docs, 64, with_ids=True).collect()
    whole = {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.piece)):
        whole.setdefault(p.doc_id, []).append(p)
    for doc_id, text in {(r[0], r[1]) for r in odd_rows if r[0] != 7}:
        own = whole[doc_id]
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert all(p.length == 64 for p in own[1:]) and own[-1].ids[-1] == packing.END and all(len(p.ids) == p.length for p in own)
    assert len(whole[7]) == 2 and [p.ids for p in whole[2]] == [[packing.END]] == [p.ids for p in whole[3]]
    out = packing.pack_documents(docs, 64).collect()
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 64
    assert len(out) == len(pieces) and len(by) == brute.best_fit_bins([p.length for p in pieces], 64)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("per_pass", [1 << 15, 2])
def test_top_k(spark, per_pass):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)).astype("float32")
    x[10:40] = x[5]  # ties
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(400, None), (500, [1.0, None] + [0.0] * 22), (600, [float("nan")] * 24), (700, [float("inf")] * 24), (None, [9.0] * 24),
             (800, [1.0, 2.0]), (900, [3.0, -1.0]), (901, [0.5, 0.25]), (1000, []), (1, rows[1][1])]
    df = spark.createDataFrame([(*r, "rank?") for r in rows], "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10, block=32, queries_per_pass=per_pass, start=20).collect()]
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_bounds_never_fall_below_the_product():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-900, 900, (50, 30)), rng.integers(-900, 900, (60, 30))
    before = np.full((50, 60), np.inf)
    for segments in topk.levels_of(30):
        bound = topk.segment_statistics(a.astype(float), segments) @ topk.segment_statistics(b.astype(float), segments).T
        assert (bound + 1e-3 >= a @ b.T).all() and bound.mean() <= before.mean()
        before = bound
