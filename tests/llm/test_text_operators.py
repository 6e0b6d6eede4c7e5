import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leafsift.llm import pii
from leafsift.llm.decontamination import benchmark_matches, hit_words, without_benchmark
from leafsift.llm.line_dedup import without_common_lines
from leafsift.llm.sharding import shard_by_bytes

from . import brute


def rows_of(rows):
    return [(r[0], r[1]) for r in rows]


def common_lines():
    rng = random.Random(3)
    return [(i, "\n".join([f"  Common\tA {rng.randint(0, 2)} ", f"own {i}"] * rng.randint(1, 3) + ["Nine"] * (i < 9))) for i in range(100, 140)]


def test_line_dedup(make_docs, odd_rows):
    rows = odd_rows + common_lines()
    docs = make_docs(rows)
    out = without_common_lines(docs)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute.line_dedup(rows_of(rows)), key=repr)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert sum(g[2] for g in got) > 0
    assert without_common_lines(docs.limit(0)).count() == 0


def test_runs_do_not_change_the_result(make_docs):
    docs = make_docs(common_lines())
    few, many = (sorted(map(str, without_common_lines(docs, batches=b).collect())) for b in (1, 9))
    assert few == many


def test_shards(make_docs, odd_rows):
    rows = odd_rows + [(i, "copy of one text") for i in range(200, 900)] + [(i, "x" * (i % 97)) for i in range(1000, 2500)]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shard_by_bytes(make_docs(rows)).collect()]
    # Equal rows are interchangeable; all else is given by the order.
    assert sorted(got, key=repr) == sorted(brute.shards(rows_of(rows)), key=repr)
    assert shard_by_bytes(make_docs(rows).limit(0)).count() == 0


def test_few_splitters_are_subdivided(make_docs):
    rows = [(i, "copy" if i % 2 else f"text {i}") for i in range(3000)]
    got = [(r.doc_id, r.shard, r.slot) for r in shard_by_bytes(make_docs(rows), shards=4, rows_per_range=10).collect()]
    assert sorted(got) == sorted((b[0], b[3], b[4]) for b in brute.shards(rows, 4))


PII = [
    "mail a.b+c@mail.example.com, x@y.z@w.v.u or a@b", "ip 1.2.3.4.5.6.7.8 and 300.1.1.1 and 010.000.255.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 7536784127813050 4845168114407329", "call +1 (988) 555-2485 or +12 34, ++49 30 1234567--",
    "a@b.c%x@d.e 😀 é@é.com +1 ( ", "1" * 50_000, "1," * 50_000, "1 " * 30_000, "a." * 50_000 + "@b.c", "@" * 1000, "x@y.z " * 700, "1.1.1.1 " * 600,
]


def test_rules(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(PII)]
    out = pii.find_personal_data(make_docs(rows), pii.SpanModel([], [], {}))
    got = sorted(((r.doc_id, sorted(tuple(s) for s in r.base)) for r in out.collect()), key=repr)
    assert got == sorted(((i, brute.spans(t)) for i, t in rows_of(rows)), key=repr)
    one = out.filter("doc_id = 100").select(pii.written(F.col("base")), "n_email").first()
    assert one[0].startswith("email:5:27") and one[1] == 2


def test_trees_add_and_leave_alone(make_docs):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(900):
        phone = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows += [(3 * i, f"some words then +1 {phone} and more"), (3 * i + 1, f'the token = "{hexes(40)}" of it'),
                 (3 * i + 2, f"Version {rng.randint(1, 9)}.{rng.randint(0, 9)} of {rng.randint(10, 99)} things")]
    docs = make_docs(rows + [(100_000, f"plain {hexes(40)} alone"), (100_001, "Version 2.0 only"), (100_002, None)])
    model = pii.SpanModel.fit(docs)
    out = {r.doc_id: [pii.KINDS[s.kind] for s in r.added] for r in pii.find_personal_data(docs, model).filter("doc_id >= 100000").collect()}
    assert out == {100_000: ["secret"], 100_001: [], 100_002: []}
    text = {r.doc_id: r.text for r in pii.redacted(docs, model).filter("doc_id IN (0, 100001, 100002)").collect()}
    assert text == {0: "some words then [phone] and more", 100_001: "Version 2.0 only", 100_002: None}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def proposed(make_docs, text):
    row = make_docs([(1, text)]).select(pii.candidates(F.col("text")).alias("c")).first()
    return {text[c.start:c.end] for c in row.c}


def test_overlapping_proposals(make_docs):
    assert {"12 555-123-4567", "555-123-4567"} <= proposed(make_docs, "item 12 555-123-4567")
    assert {"2024 (555) 123-4567", "(555) 123-4567"} <= proposed(make_docs, "in 2024 (555) 123-4567 99")
    assert "hunter2" in proposed(make_docs, "😀 password: hunter2.") and "swordfish" in proposed(make_docs, 'pwd="swordfish"')
    assert proposed(make_docs, "the secret of success, a token here") == set()
    assert len(proposed(make_docs, "7 " * 20_000)) < 100  # distinct texts; the spans stay bounded per group


def test_best_spans_that_do_not_overlap(spark):
    spans = [(0, 2, 15, 1.0), (3, 3, 15, 2.0), (3, 3, 7, 1.5), (15, 3, 20, 0.5), (18, 4, 30, 0.4), (25, 4, 40, 0.6)]
    row = spark.createDataFrame([(spans,), ([],)], "s array<struct<start:int,kind:int,end:int,score:double>>")
    got = [sorted(tuple(x) for x in r[0]) for r in row.select(pii.best_apart(F.col("s"))).collect()]
    assert got == [[(3, 3, 15), (15, 3, 20), (25, 4, 40)], []]


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item, here"), (3, None), (4, "..."),
         (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (10, "short ITEM here"), (None, "unnamed thing éa")]


@pytest.mark.parametrize("pass_words", [500_000, 5])
def test_decontamination(spark, make_docs, odd_rows, pass_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu short item here other".split()
    rows = odd_rows + [(50, "x " + ITEMS[0][1].upper() + " y " + ITEMS[0][1]), (51, "a short item, here short item"), (52, "Unnamed\nthing ÉA éa")]
    rows += [(60 + i, " ".join(w for _ in range(40) for w in (words if rng.random() < 0.2 else [rng.choice(words)]))) for i in range(20)]
    got = [(r.doc_id, r.n_words, r.h, r["items"]) for r in benchmark_matches(make_docs(rows), bench, pass_words=pass_words).withColumn("h", hit_words(F.col("hits"))).collect()]
    want = brute.contamination(rows_of(rows), ITEMS)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = without_benchmark(make_docs(rows), bench)
    assert kept.columns == make_docs(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(w[0] or -1 for w in want if not w[2])


def test_longest_match_and_empty_tables(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    r = benchmark_matches(make_docs([(1, "no alpha beta gamma delta epsilon zeta eta theta iota kappa lambda, end")]), bench).first()
    assert (r.longest, r.longest_at, r.longest_item) == (11, 1, "1")
    assert benchmark_matches(make_docs([(1, "a")]), bench.limit(0)).first().hits == []
    assert benchmark_matches(make_docs([(1, "a")]).limit(0), bench).count() == 0


@pytest.mark.parametrize("pass_words", [500_000, 30])
def test_longest_match_against_brute_force(spark, make_docs, pass_words):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(12)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(1, 40)))) for i in range(12)]
    rows = [(i, " ".join(say(rng.randint(0, 9)) + (rng.choice(items)[1].split()[rng.randint(0, 20) :] + ["unknown"]) * rng.randint(0, 1) + say(15)))
            for i in range(60)] + [(60, "nothing shared"), (61, None), (62, "w3"), (63, items[3][1]), (64, items[3][1] + " " + items[5][1])]
    got = benchmark_matches(make_docs(rows), spark.createDataFrame(items, "item_id long, text string"), pass_words=pass_words)
    named = {str(i): t.split() for i, t in items}
    for r in got.collect():
        doc = (dict(rows)[r.doc_id] or "").split()
        assert (r.longest, r.longest_at) == brute.longest_match(doc, named.values())
        if r.longest:
            match, item = doc[r.longest_at : r.longest_at + r.longest], named[r.longest_item]
            assert any(item[k : k + r.longest] == match for k in range(len(item)))
        else:
            assert r.longest_item is None


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_disguised_addresses_bare_phones_and_short_secrets(make_docs):
    rng = random.Random(21)
    words = "the of river and house with green from this stone which walk".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phone = lambda: f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    plain = [lambda: f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", phone, lambda: f"in {rng.randint(1800, 2030)}",
             lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 99)} percent", lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
             lambda: f"order {rng.randint(1000000, 9999999)}", lambda: f"{rng.randint(1, 99)},{rng.randint(100, 999)}", lambda: f"at {rng.choice(words)}.{rng.choice(words)}",
             lambda: f"password: {rng.choice(words)}{rng.randint(10, 99)}"]
    rows = [(i, f"{say(8)} {rng.choice(plain)()} {say(8)} {rng.choice(plain)()} {say(3)}") for i in range(3_000)]
    hidden = {"email": lambda i: f"{say(4)} " + ("jane.doe{0} [at] example{0} [dot] com", "jane{0} at host{0} dot org", "j_{0}(at)mail.example.net")[i % 3].format(i),
              "phone": lambda i: f"{say(4)} call us on 0{rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
              "secret": lambda i: f"{say(4)} password: " + ("hunter{}", "x{}!y", "let-me-in{}")[i % 3].format(i)}
    planted = [(10_000 + 1_000 * k + i, f"{make(i)} {say(6)}", kind) for k, (kind, make) in enumerate(hidden.items()) for i in range(150)]
    clean = [(20_000 + i, f"{say(6)} {rng.choice(plain[2:8])()} {say(6)}") for i in range(600)]
    out = {r.doc_id: [pii.KINDS[x.kind] for x in r.added] for r in
           pii.find_personal_data(make_docs(rows + [p[:2] for p in planted] + clean)).filter("doc_id >= 10000").collect()}
    for kind in hidden:
        found = [kind in out[i] for i, _, k in planted if k == kind]
        assert sum(found) >= 0.9 * len(found), (kind, sum(found))
    assert sum(bool(out[i]) for i, _ in clean) <= 0.02 * len(clean)


def test_selected_spans_against_brute_force(make_docs):
    """A fixed model (tokens of letters over 15 signs): the spans of a plain search, none of which touches one of the rules."""
    rng = random.Random(22)
    pieces = ["word", "A1b2C3d4E5f6G7h8", "x" * 40 + "1", "no_digits_in_this_piece", "1234567890123456789", "a.b@long-host-name-0001.example.com", "😀", "10.0.0.1", "ab12", "\n", "key=Zz9yy8xx7ww6vv5uu4"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    model = pii.SpanModel([(1.0, ["If (feature 0 <= 15.5)", "Predict: -1.0", "Else (feature 0 > 15.5)", "Predict: 1.0"])], ["length", *pii.CONTEXT], {4: 0.5})
    out = {r.doc_id: sorted((x.start, x.end) for x in r.added) for r in pii.find_personal_data(make_docs(list(enumerate(texts))), model).collect()}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, text in enumerate(texts):
        taken = [m.span() for m in mail.finditer(text)]
        want = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}=*", text)
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
        assert out[i] == want, text


def test_thresholds_come_from_all_texts(make_docs):
    """A kind that hardly a sampled text shows is judged by what the whole table holds."""
    rows = [(i, f"plain words {i} and 20{i % 90 + 10}") for i in range(4_000)]
    rows += [(5_000 + i, f"write to user{i}@mail.example.com or +1 555 {100 + i % 800} {1000 + i}") for i in range(400)]
    docs = make_docs(rows)
    trees = pii.SpanModel.fit_trees(docs, rows=1_500)
    assert trees.trees and not trees.thresholds
    trees.calibrate(pii._judged(docs, trees))
    assert {0, 3} <= trees.thresholds.keys()
