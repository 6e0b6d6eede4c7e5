import random
import re
from collections.abc import Iterator

import pandas as pd
import pytest
from leafsift.functions import lemmas
from leafsift.operators import assembly, automaton, cleaning, matching, naive_bayes, patterns, ranking, selection, tokens
from leafsift.plans.registry import METRICS, get_keywords, get_metric, get_patterns, with_patterns
from pyspark.sql import functions as F
from restated import first_match, phrase_patterns

WORDS = ("total average number of staff employees people team employ hired 12 3,400 7.5 % percent $ the our with have "
         "headcount workforce there were work contractors employee gender balance by across female sadly fatality fatalities "
         "died deaths safety ethnic minority black asian and colour bame parker review Board nationality nationalities countries "
         "serving represented medical insurance cover limited life benefits pay ratio ceo TRIR LTIFR lost - time injury frequency "
         "rate , . UK French twenty one/2 1/2 for in per x").split()


def annotated(spark, texts):
    rows = spark.createDataFrame([(f"A_Annual_Report_{i}.pdf", 1, 1, t) for i, t in enumerate(texts)],
                                 "filename string, page int, paragraph int, text string")
    return rows, [(r["text"], [t.asDict() for t in r["tokens"]]) for r in tokens.annotate(rows).collect()]


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 14))) for _ in range(900)]
    # Dense texts, so that every pattern has hits.
    for m in METRICS.values():
        if m.kind == "phrase":
            texts += [t for p in m.patterns for t in (f"our {p.upper()} rose", f"x{p}", p.title())]
    rows, tokenised = annotated(spark, texts)
    token_of = dict(tokenised)
    got = {}
    for r in matching.match_blocks(rows, list(METRICS)).collect():
        got[r["metric"], r["text"]] = (r["start"], r["end"])
    hits = 0
    for name, m in METRICS.items():
        rules = m.patterns if m.kind == "text" else phrase_patterns(m.patterns)
        for text in set(texts):
            want = first_match(token_of[text], rules)
            assert got.get((name, text)) == (want[:2] if want else None), (name, text)
            hits += want is not None
    assert hits > 500


def test_quantifiers_one_by_one(spark):
    texts = ["a", "a b", "a b b", "a c", "b", "a x c", "c a", "a b c"]
    rows, tokenised = annotated(spark, texts)
    for op in (None, "?", "*", "+", "!"):
        pattern = [{"LOWER": "a"}, {"LOWER": "b", **({"OP": op} if op else {})}, {"LOWER": "c", "OP": "?"}]
        found = {r["text"] for r in automaton.with_matches(rows.withColumn("of", F.col("text")), [([pattern], "text")], "of")
                 .filter(F.size("_found") > 0).collect()}
        assert found == {t for t, toks in tokenised if first_match(toks, [pattern])}, op


def test_automaton_equals_brute_force_on_random_patterns():
    rng = random.Random(11)
    letters = "abcd"
    for _ in range(150):
        sets = [[[{"LOWER": rng.choice([*letters, {"IN": ["a", "b"]}, {"NOT_IN": ["c"]}]), **({"OP": op} if (op := rng.choice([None, None, "?", "*", "+", "!"])) else {})}
                  for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))] for _ in range(3)]
        machine = automaton.Automaton(sets)
        for _ in range(12):
            toks = [{"text": w, "lower": w, "lemma": w, "pos": "X", "ent": "", "like_num": False, "is_punct": False} for w in rng.choices(letters, k=rng.randint(0, 9))]
            kinds = [machine.class_of(tuple(t.values())) for t in toks]
            got = {s: (a, a + n, p) for s, a, n, p in machine.first_matches(kinds)}
            # A pattern of optional tokens alone matches nothing.
            want = {s: first_match(toks, [p if any(t.get("OP") not in ("?", "*") for t in p) else [{"LOWER": "zz"}] for p in ps]) for s, ps in enumerate(sets)}
            assert got == {s: w for s, w in want.items() if w}


def test_negated_token_consumes_one(spark):
    rows, _ = annotated(spark, ["50 contractors", "50 agency contractors", "50 employee contractors"])
    got = {r["text"] for r in matching.match_blocks(rows, ["n_contractors"]).collect()}
    assert got == {"50 agency contractors"}


def test_match_string_is_the_text(spark):
    rows, _ = annotated(spark, ["We had  an average number of employees, 12% more."])
    r = matching.match_blocks(rows, ["n_employees"]).first()
    assert (r["match_string"], r["start"], r["end"]) == ("average number of employees", 4, 8)  # a space run is a token


def test_token_attributes(spark):
    _, [(_, toks)] = annotated(spark, ["In the UK 12% of French staff earn $ 40, not 1/2."])
    by_text = {t["text"]: t for t in toks}
    assert by_text["12"]["ent"] == by_text["%"]["ent"] == "PERCENT"
    assert by_text["40"]["ent"] == "MONEY" and by_text["1/2"]["ent"] == "CARDINAL"
    assert by_text["UK"]["ent"] == "GPE" and by_text["French"]["ent"] == "NORP"
    assert by_text["In"]["pos"] == "ADP" and by_text[","]["is_punct"]


def test_lemmas(spark):
    _, rows = annotated(spark, ["employees countries businesses is died serving staff people always boxes"])
    assert [t["lemma"] for t in rows[0][1]] == ["employee", "country", "business", "be", "die", "serve", "staff", "people",
                                                "always", "box"]


@pytest.mark.parametrize("lemma, forms", [
    ("employ", "employ employs employed employing"), ("run", "runs running"), ("diversify", "diversifies diversified diversifying"),
    ("serve", "serves served serving"), ("hire", "hire hires hired hiring"), ("represent", "represents represented representing"),
    ("average", "averages averaged averaging"), ("plan", "planned planning"), ("measure", "measured measuring"), ("change", "changed changing"),
    ("big", "big biggest"), ("early", "early earliest"), ("use", "used using"), ("work", "worked working"), ("need", "need needs needed"),
    ("thing", "thing things"), ("king", "king"), ("during", "during"), ("status", "status"), ("analysis", "analysis"), ("red", "red"), ("été", "été"),
    ("3.5", "3.5"), ("die", "died dying"), ("class", "classes"), ("provide", "provided providing"), ("develop", "developed developing")])
def test_lemma_rules(lemma, forms):
    assert {lemmas.lemma(f) for f in forms.split()} == {lemma}


def test_inflected_words_match(spark):
    """A lemma in a pattern meets all forms, and the cheap test lets them through."""
    texts = [f"we {form} 12 people" for form in ("employ", "employed", "employing", "hired", "hiring")]
    rows, _ = annotated(spark, texts)
    assert {r["text"] for r in matching.match_blocks(rows, ["n_employees"]).collect()} == set(texts)


def test_registry_errors():
    with pytest.raises(ValueError):
        get_metric("nonsense")
    with pytest.raises(ValueError):
        get_patterns(["a", "list"])
    with pytest.raises(ValueError):
        patterns.token_patterns("no list", "text")
    with pytest.raises(ValueError):
        patterns.token_patterns([], "other")
    for wrong in ({"SHAPE": "dd"}, {"POS": "VERB"}, {"LOWER": "a", "OP": "{2}"}, {"LEMMA": {"FUZZY": "a"}}):
        with pytest.raises(ValueError):
            patterns.checked([wrong])
    assert get_keywords(["x"]) == ["x"]
    assert with_patterns("ceo_pay_ratio", ["remuneration"]).patterns == ["remuneration"]


def test_annotator_hook(spark):
    rows, _ = annotated(spark, ["anything at all"])
    schema = ("array<struct<text string, lower string, lemma string, pos string, ent string, like_num boolean, "
              "is_punct boolean>>")

    @F.pandas_udf(schema)
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [
                {"text": w, "lower": w, "lemma": "employee" if i else "total", "pos": "X", "ent": "", "like_num": False,
                 "is_punct": False} for i, w in enumerate(t.split())])

    got = matching.match_blocks(rows, ["n_employees"], annotator=model).first()
    assert got["match_string"] == "anything at"


PAGES = {
    "A_Annual_Report_2020.pdf": {1: ["a total", "recordable case", "x"], 2: ["a total", "y", "recordable"], 3: ["Total", " ", "recordable"],
                                 4: ["TRIR 3"], 5: ["the pay", "ratio"], 6: ["females"], 7: ["totals", "recordable"], 8: ["x recordable", "total"]},
    "B_Annual_Report_2021.pdf": {1: ["lost", "time", "injury"], 2: ["nothing"]},
}


@pytest.mark.parametrize("metric", [*METRICS, ["male"], ["^the", "r.tio$"], ["lost time injury", "zz zz"], ["total recordable case", "n[ao]t"]])
def test_page_selection_equals_joined_text(make_blocks, metric):
    import re
    want = {(f, p) for f, pages in PAGES.items() for p, texts in pages.items()
            if any(re.search(k, " ".join(texts).lower()) for k in get_keywords(metric))}
    blocks = selection.select_pages(make_blocks(PAGES), metric).collect()
    assert {(r["filename"], r["page"]) for r in blocks} == want
    assert len(blocks) == sum(len(PAGES[f][p]) for f, p in want)


def test_no_phrase_across_the_rest_of_a_block(make_blocks):
    blocks = make_blocks({"A_Annual_Report_2020.pdf": {1: ["x", "ab chief executives and more", "pay rise", "the chief"],
                                                       2: ["the chief", "executive", "pay rise"], 3: ["the chief", "", "executive pay"]}})
    got = selection.select_pages(blocks, ["chief executive pay"]).select("page").distinct().collect()
    assert [r["page"] for r in got] == [2]


def test_match_table_needs_the_page(make_blocks):
    blocks = make_blocks({"A_B_Annual_Report_2020.pdf": {1: ["TRCR fell"], 2: ["TRCR fell", "an injury"], 3: ["TRIFR"]}})
    rows = matching.match_table(blocks, "trifr").orderBy("page").collect()
    assert [(r["name"], r["year"], r["page"], r["match_string"]) for r in rows] == [("A B", "2020", 2, "TRCR"), ("A B", "2020", 3, "TRIFR")]


LONG = 100_000


@pytest.mark.parametrize("text, metric, span", [
    ("our " + "7 " * LONG + "employees", "n_employees", (0, LONG + 2)),
    ("7 " * LONG + "% board female", "company_gender_diversity", (0, LONG + 3)),
    ("7 " * LONG + "and ethnic", "company_ethnic_diversity", (0, LONG + 2)),
    ("7 " * LONG + "nothing follows here at all", "company_ethnic_diversity", None),
    ("number of " + "word " * LONG + "dead died", "n_fatalities", (0, LONG + 4)),
    ("died " + "7 " * LONG, "n_fatalities", None),
    ("employees " + "word " * LONG + "nationality", "international_diversity", None),
    ("employee " * LONG + "nationality", "international_diversity", (0, LONG + 1)),
    ("medical " * LONG + "insurance insurance insurance", "healthcare", (0, LONG + 2)),
    ("contractors " * LONG + "7", "n_contractors", (LONG - 5, LONG + 1)),
    ("gender " * LONG, "company_gender_diversity", None),
    ("1" + ",1" * LONG + " employees work", "n_employees", (0, 3)),
    ("1" + ".1" * LONG + " x", "board_gender_diversity", None),
    ("pay " * LONG + "ratio", "ceo_pay_ratio", (LONG - 1, LONG + 1)),
])
def test_long_blocks(spark, text, metric, span):
    rows = spark.createDataFrame([("A_Annual_Report_1.pdf", 1, 1, text.strip())], "filename string, page int, paragraph int, text string")
    got = [(r["start"], r["end"]) for r in matching.match_blocks(rows, [metric]).select("start", "end").collect()]
    assert got == ([span] if span else [])


def test_growing_sides_are_not_broadcast(spark, make_blocks):
    """Written tables look small to the planner; neither page keys nor table numbers nor terms may go through the driver for that."""
    table = "Quantity\nPrice\nItem\n12\n345\n67\n890\n12\n"
    blocks = make_blocks({f"A{i}_Annual_Report_2020.pdf": {1: ["The LTIFR improved.", table, table], 2: [table]} for i in range(20)})
    numbered = cleaning.number_tables(blocks.filter(cleaning.is_table()))
    matches = matching.match_table(cleaning.clean_blocks(blocks, write_tables=True), "ltifr")
    flagged = ranking.flag_frequent_pages(matches)
    model = naive_bayes.train(matches.select("text", F.lit(1).alias("class")).unionByName(blocks.select("text", F.lit(0).alias("class"))))
    scored = naive_bayes.score(matches, ["filename", "page", "paragraph"], *model)
    for df, rows in ((numbered, 60), (matches, 20), (flagged, 20), (scored.drop("likelihood"), 20), (assembly.collect_parts(flagged, 2), 20)):
        assert len(df.collect()) == rows
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Totals of one row come by a broadcast of their own; a shuffled side, whose size is measured, may become one.
        wide = [line for line in plan.split("\n") if "BroadcastHashJoin" in line and ("_salt" in line or "_paras" in line)]
        assert not wide and "SortMergeJoin" in plan
