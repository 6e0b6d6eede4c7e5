"""One query per operator, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.functions import text as X
from leafsift.operators import (
    assembly, automaton, categories, cleaning, evaluate, features, linear, matching, naive_bayes, ranking, sampling,
    selection, tokens,
)
from leafsift.plans import assess, training
from leafsift.plans.registry import METRICS, get_keywords
from leafsift.session import shared_dir
from leafsift.sources import models, reports, tables
from leafsift_checks.derived import report_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEXTS = ("documents", "pages", "conversations")
ADHOC = ["the", "lic[ei]n", "of the"]
FREE = ["pri.*lost", "headcount"]
LONG_PHRASES = ["is a total recordable", "a total recordable case rate", "every market the ceo pay"]


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores, such as one small file, over all cores; leave others alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_Annual_Report_"),
                    (2000 + F.col("doc_id") % 20).cast("string"), F.lit(".pdf"))
    return reports.blocks_from_text(table(spark, sf_dir, "documents"), name)


def labelled(spark: SparkSession, sf_dir: str, label: str = "toxic") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("class")).filter(F.col("class").isNotNull())
    return docs.join(marks, "doc_id")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_blocks(report_blocks(spark, sf_dir), write_tables=True)


def rounded(column: str, places: int = 6):
    return F.round(column, places).alias(column)


# --- sources ---------------------------------------------------------------
@query
def s02_blocks_from_text(spark, sf_dir):
    return document_blocks(spark, sf_dir)


@query
def s02_blocks_from_html(spark, sf_dir):
    return reports.blocks_from_html(
        table(spark, sf_dir, "pages"), F.concat(F.lit("Page_"), F.col("page_id").cast("string"))
    )


@query
def s02_blocks_from_turns(spark, sf_dir):
    return reports.blocks_from_turns(
        table(spark, sf_dir, "conversations"), F.concat(F.lit("Talk_"), F.col("conv_id").cast("string")), F.col("turn") + 1
    )


@query
def s04_labelled_passages(spark, sf_dir):
    """Labelled passages written as CSV, texts over several lines, and scanned again."""
    rows = labelled(spark, sf_dir).select("text", "class")
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_labelled(spark, path)


@query
def s04_labelled_lines(spark, sf_dir):
    """The same with one record a line, which lets Spark split the files."""
    rows = labelled(spark, sf_dir).select(F.translate("text", "\n\r", "  ").alias("text"), "class")
    path = f"{shared_dir(spark)}/labelled-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return tables.read_labelled(spark, path, multi_line=False)


@query
def s05_match_table(spark, sf_dir):
    """A match table written by the CSV sink and read again."""
    path = f"{shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    tables.write_matches(matching.match_table(cleaned(spark, sf_dir), "ltifr"), path)
    return tables.read_matches(spark, path).drop("metric")


@query
def s06_saved_model(spark, sf_dir):
    """Two versions of a model saved, the current one loaded."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for alpha in (1.0, 0.25):
        models.save_model(spark, path, "toxic", (*naive_bayes.train(labelled(spark, sf_dir), alpha), (1, 1)))
    vocabulary, totals, ngram_range = models.load_model(spark, path, "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = naive_bayes.score(docs, ["doc_id"], vocabulary, totals, ngram_range)
    return out.select("doc_id", rounded("likelihood"), "predicted_class")


@query
def s06_saved_linear_model(spark, sf_dir):
    """A linear model saved and loaded."""
    path, rows = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", balanced(spark, sf_dir)
    models.save_model(spark, path, "toxic", linear.train_linear(rows, "LinearSVC", C=1.0))
    return models.load_model(spark, path, "toxic").predict(rows).select("doc_id", "class", rounded("score", 4), "prediction")


def _paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit(".pdf"))).otherwise(
        F.concat("source", F.lit("_Group_plc_Annual_Report_"), F.col("doc_id").cast("string"), F.lit(".v2.pdf"))
    )
    return docs.select(F.concat(F.lit("file:/data/raw/"), name).alias("path"))


@query
def s03_report_metadata(spark, sf_dir):
    return reports.parsed_reports(reports.report_metadata(_paths(spark, sf_dir)))


@query
def s03_quarantined_reports(spark, sf_dir):
    return reports.quarantined_reports(reports.report_metadata(_paths(spark, sf_dir)))


@query
def s07_first_reports(spark, sf_dir):
    return reports.first_reports(document_blocks(spark, sf_dir), 80).groupBy("filename").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.max("page").alias("pages"))


# --- cleaning --------------------------------------------------------------
@query
def c01_count_characters(spark, sf_dir):
    return cleaning.count_characters(document_blocks(spark, sf_dir), r"(?U)\d+")


@query
def c02_audit_characters(spark, sf_dir):
    out = cleaning.audit_characters(report_blocks(spark, sf_dir))
    return out.select("filename", "n_bad", "n_chars", rounded("pct_bad"))


@query
def c03_round_significant(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("price")).select(
        "l_orderkey", X.round_significant("price", 2).alias("two"), X.round_significant("price", 4).alias("four"))


@query
def c04_find_tables(spark, sf_dir):
    return cleaning.find_tables(report_blocks(spark, sf_dir))


@query
def c05_stitch_tables(spark, sf_dir):
    return cleaning.stitch_tables(report_blocks(spark, sf_dir))


@query
def c06_table_words(spark, sf_dir):
    return report_blocks(spark, sf_dir).select("filename", "page", "paragraph", cleaning.table_words().alias("words"))


@query
def c07_substitute_tables(spark, sf_dir):
    return cleaning.substitute_tables(report_blocks(spark, sf_dir))


@query
def c07_keep_last_table(spark, sf_dir):
    return cleaning.substitute_tables(report_blocks(spark, sf_dir), keep_last_table=True)


@query
def c08_without_tables(spark, sf_dir):
    return cleaning.substitute_tables(report_blocks(spark, sf_dir), table_contents=False)


@query
def c09_drop_junk(spark, sf_dir):
    return cleaning.drop_junk(report_blocks(spark, sf_dir))


@query
def c10_normalise(spark, sf_dir):
    return cleaning.normalise(document_blocks(spark, sf_dir))


@query
def c11_clean_blocks(spark, sf_dir):
    return cleaning.clean_blocks(report_blocks(spark, sf_dir))


@query
def c11_pages_after_cleaning(spark, sf_dir):
    blocks = report_blocks(spark, sf_dir)
    return cleaning.pages_after_cleaning(blocks, cleaning.clean_blocks(blocks))


@query
def c12_table_cells(spark, sf_dir):
    return cleaning.table_cells(cleaning.find_tables(report_blocks(spark, sf_dir)))


# --- page selection --------------------------------------------------------
@query
def p01_select_pages(spark, sf_dir):
    return selection.select_pages(cleaned(spark, sf_dir), "n_employees")


@query
def p01_select_pages_across_blocks(spark, sf_dir):
    return selection.select_pages(cleaned(spark, sf_dir), "trifr")


@query
def p02_keyword_hits(spark, sf_dir):
    words = {k: [k] for k in dict.fromkeys(k for m in METRICS for k in get_keywords(m))}
    hits = selection.page_hits(cleaned(spark, sf_dir), words)
    return hits.groupBy(F.col("metric").alias("keyword")).agg(F.count(F.lit(1)).alias("pages"))


@query
def p03_adhoc_keywords(spark, sf_dir):
    return selection.select_pages(document_blocks(spark, sf_dir), ADHOC)


@query
def p03_long_phrases(spark, sf_dir):
    """Phrases of four and five words that run over block ends."""
    return selection.select_pages(cleaned(spark, sf_dir), LONG_PHRASES)


@query
def p03_adhoc_regex(spark, sf_dir):
    return selection.select_pages(cleaned(spark, sf_dir), FREE)


@query
def p04_many_metrics(spark, sf_dir):
    return selection.select_pages_many(cleaned(spark, sf_dir), list(METRICS))


# --- matching --------------------------------------------------------------
@query
def m01_annotate_tokens(spark, sf_dir):
    """Tokens as lines ``lower|lemma/flags~text``."""
    def line(t):
        letters = [F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), t[name])
                   for table, name in ((tokens.POS_LETTERS, "pos"), (tokens.ENT_LETTERS, "ent"))]
        return F.concat(F.lit("\n"), t["lower"], F.lit("|"), t["lemma"], F.lit("/"), *letters, F.when(t["like_num"], "N").otherwise(""),
                        F.when(t["is_punct"], "U").otherwise(""), F.lit("~"), t["text"])
    out = tokens.annotate(cleaned(spark, sf_dir))
    return out.select("filename", "page", "paragraph", F.array_join(F.transform("tokens", line), "").alias("encoded"))


@query
def m02_pattern_hits(spark, sf_dir):
    """Blocks hit by each single pattern of all metrics: every pattern is a set of its own in one automaton."""
    named = {f"{m.name}_{i}": ([p], m.kind) for m in METRICS.values() for i, p in enumerate(m.patterns)}
    found = automaton.with_matches(cleaned(spark, sf_dir).select("text"), list(named.values()), "text")
    return found.agg(*[F.count_if(F.array_contains("_found.set", F.lit(i))).alias(name) for i, name in enumerate(named)])


def _match_query(metric: str) -> Query:
    def run(spark, sf_dir):
        return matching.match_table(cleaned(spark, sf_dir), metric).drop("metric")
    return run


for _m in ("n_employees", "company_gender_diversity", "n_fatalities", "company_ethnic_diversity", "international_diversity"):
    QUERIES[f"m06_match_table_{_m}"] = _match_query(_m)
for _m in ("ltifr", "trifr", "ceo_pay_ratio", "parental_care"):
    QUERIES[f"m04_phrase_match_{_m}"] = _match_query(_m)
for _m in ("n_contractors", "healthcare"):
    QUERIES[f"m03_token_match_{_m}"] = _match_query(_m)


@query
def m05_matches_by_metric(spark, sf_dir):
    out = matching.match_table(cleaned(spark, sf_dir), list(METRICS))
    kinds = F.when(F.col("metric").isin([m.name for m in METRICS.values() if m.kind == "text"]), "text").otherwise("phrase")
    return out.groupBy("metric", kinds.alias("kind")).agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("filename").alias("reports"))


# --- ranking ---------------------------------------------------------------
def _scored(spark, sf_dir):
    """Blocks as if scored: a likelihood that depends on their place."""
    return report_blocks(spark, sf_dir).select(
        "filename", F.floor(F.col("page") / 3).cast("int").alias("page"),
        (F.col("page") * 10 + F.col("paragraph")).alias("paragraph"),
        ((F.col("page") * 31 + F.col("paragraph") * 7) % 20 / F.lit(20.0)).alias("likelihood"))


@query
def r01_best_page(spark, sf_dir):
    return ranking.flag_best_page(_scored(spark, sf_dir))


@query
def r01_winning_pages(spark, sf_dir):
    return ranking.best_pages(_scored(spark, sf_dir))


@query
def r02_frequent_pages(spark, sf_dir):
    return ranking.flag_frequent_pages(_scored(spark, sf_dir)).drop("likelihood")


# --- classification --------------------------------------------------------
@query
def t01_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", features.clean_text("text").alias("text"))


@query
def t02_tokenise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(features.words("text"), "\n").alias("words"), F.size(features.words("text")).alias("n"))


@query
def t03_joined_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", features.joined_words("text").alias("text"))


@query
def t04_ngram_counts(spark, sf_dir):
    counted = features.term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), ngram_range=(1, 3))
    return features.term_weights(counted).groupBy("term").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query
def t05_l2_weights(spark, sf_dir):
    counted = features.term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return features.term_weights(counted).select("doc_id", "term", "n", rounded("w"))


@query
def t06_nb_model(spark, sf_dir):
    vocabulary, _ = naive_bayes.train(labelled(spark, sf_dir), 0.25)
    return vocabulary.select("term", rounded("theta0"), rounded("theta1"))


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.balance_classes(labelled(spark, sf_dir), F.col("doc_id"))


@query
def t07_linear_svc(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    return linear.train_linear(rows, "LinearSVC", C=1.0).predict(rows).select("doc_id", "class", rounded("score", 4), "prediction")


@query
def t08_sgd_hinge(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    return linear.train_linear(rows, "SGDClassifier", alpha=1e-3).predict(rows).select("doc_id", "class", rounded("score", 4), "prediction")


@query
def t09_train_totals(spark, sf_dir):
    _, totals = training.train_classifier(labelled(spark, sf_dir, "quality"), "MultinomialNB", (1, 2), alpha=0.5)
    return totals.select(rounded("s0", 4), rounded("s1", 4), "v", "n0", "n1", rounded("prior0"), rounded("prior1"))


@query
def t10_balanced(spark, sf_dir):
    return sampling.balance_classes(labelled(spark, sf_dir), F.col("doc_id")).select("doc_id", "class")


@query
def t10_balanced_1_to_3(spark, sf_dir):
    return sampling.balance_classes(labelled(spark, sf_dir), F.col("doc_id"), 3).select("doc_id", "class")


@query
def t11_mask_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.mask_numbers("text").alias("text"))


@query
def t11_mask_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate").cast("string")).otherwise(
        F.concat(F.lit("up "), F.col("o_custkey").cast("string"), F.lit(".5% in "), F.year("o_orderdate").cast("string")))
    return cells.select("o_orderkey", X.mask_numbers(text).alias("masked"))


def _folds(spark, sf_dir, k=10):
    return sampling.stratified_folds(labelled(spark, sf_dir), F.col("doc_id"), k)


@query
def t12_folds(spark, sf_dir):
    return _folds(spark, sf_dir).select("doc_id", "class", "fold")


@query
def t12_cv_predictions(spark, sf_dir):
    """Balanced classes with numbers masked."""
    predicted, _ = training.cross_validated(labelled(spark, sf_dir), "doc_id", "MultinomialNB", alpha=0.25, balance=True, replace_nums=True)
    return predicted.select("doc_id", "class", "fold", rounded("likelihood"), "prediction")


@query
def t13_scores(spark, sf_dir):
    _, scores = training.cross_validated(labelled(spark, sf_dir), "doc_id", "MultinomialNB", alpha=0.25, balance=True, replace_nums=True)
    return scores.select("n", *[rounded(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def t14_top_terms(spark, sf_dir):
    vocabulary, _ = naive_bayes.train(labelled(spark, sf_dir), 0.25)
    # Rounding first keeps ties the same on every engine.
    return naive_bayes.top_terms(vocabulary.select("term", rounded("theta1")), 10)


@query
def t15_grid_search(spark, sf_dir):
    """All 51 settings in 5 folds on balanced classes."""
    out = training.grid_search(labelled(spark, sf_dir), "doc_id", balance=True)
    return out.select("classifier", "ngram_high", "value", rounded("f1"))


def _likelihoods(spark, sf_dir):
    vocabulary, totals = naive_bayes.train(labelled(spark, sf_dir), 0.25)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return naive_bayes.score(docs, ["doc_id"], vocabulary, totals).select("doc_id", "likelihood", "predicted_class")


@query
def t16_batch_scores(spark, sf_dir):
    return _likelihoods(spark, sf_dir).select("doc_id", rounded("likelihood"), "predicted_class")


@query
def h01_category_model(spark, sf_dir):
    rows = balanced(spark, sf_dir)
    return linear.train_category(rows).predict(rows).select("doc_id", "class", rounded("probability", 4), "prediction")


@query
def h02_split(spark, sf_dir):
    return sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))


@query
def h03_encode_labels(spark, sf_dir):
    out = categories.encode_labels(labelled(spark, sf_dir), "healthcare")
    return out.select("doc_id", F.col("cats")["healthcare"].alias("healthcare"), F.col("cats")["no_healthcare"].alias("no_healthcare"))


def _probabilities(spark, sf_dir):
    """Fitted on four fifths of the balanced passages, told of all other labelled ones."""
    split = sampling.train_test_split(balanced(spark, sf_dir), F.col("doc_id"))
    train = split.filter("is_train").drop("is_train")
    rest = labelled(spark, sf_dir).join(train.select("doc_id"), "doc_id", "left_anti")
    return linear.train_category(train, alpha=0.01).predict(rest).select("doc_id", "class", "probability")


@query
def h04_category_scores(spark, sf_dir):
    out = evaluate.category_scores(categories.label_pairs(_probabilities(spark, sf_dir)))
    return out.select(*[rounded(c) for c in ("textcat_p", "textcat_r", "textcat_f")])


@query
def h05_decide(spark, sf_dir):
    return _probabilities(spark, sf_dir).select("doc_id", categories.decide("probability").alias("decision"))


@query
def h06_rounded_probability(spark, sf_dir):
    return _probabilities(spark, sf_dir).select("doc_id", categories.rounded("probability").alias("probability"))


# --- results ---------------------------------------------------------------
def _flat(results: DataFrame) -> DataFrame:
    """Lists as text, for comparison."""
    return results.withColumn("predicted_page", F.array_join(F.transform("predicted_page", lambda p: p.cast("string")), ",")).withColumn(
        "predicted_text", F.array_join("predicted_text", "\n"))


def _flagged(spark, sf_dir):
    matches = assess.report_matches(report_blocks(spark, sf_dir), ["parental_care"])
    return matches.withColumn("predicted_text_class", ((F.col("page") + F.col("paragraph")) % 3 == 0).cast("int"))


@query
def a02_report_class(spark, sf_dir):
    return assembly.report_classes(_flagged(spark, sf_dir)).drop("metric")


@query
def a03_positive_passages(spark, sf_dir):
    return assembly.positive_passages(_flagged(spark, sf_dir)).select("filename", "paragraph", "predicted_page", "predicted_text")


@query
def a04_collect_passages(spark, sf_dir):
    return _flat(assembly.collect_passages(_flagged(spark, sf_dir))).drop("metric")


@query
def a04_collect_in_parts(spark, sf_dir):
    return _flat(assembly.collect_parts(_flagged(spark, sf_dir), 2)).drop("metric")


@query
def a05_not_found_rows(spark, sf_dir):
    names = reports.parsed_reports(reports.report_metadata(report_blocks(spark, sf_dir), "filename"))
    return _flat(assembly.assemble(names, _flagged(spark, sf_dir), ["parental_care"])).drop("metric")


@query
def a06_assess_ltifr(spark, sf_dir):
    return _flat(assess.assess_metric(report_blocks(spark, sf_dir), "ltifr"))


def _employees(spark, sf_dir):
    """Matches and a model of them, labelled by a rule that stands in for a reader."""
    matches = assess.report_matches(report_blocks(spark, sf_dir), ["n_employees"])
    sure = F.contains("text", F.lit("number of employees")) & (F.col("page") % 5 != 0)
    rows = matches.select("text", F.when(sure, 1).otherwise(0).alias("class"))
    return matches, (*naive_bayes.train(rows, 0.25, (1, 3)), (1, 3))


@query
def a06_assess_n_employees(spark, sf_dir):
    matches, model = _employees(spark, sf_dir)
    return _flat(assess.assess_metric(report_blocks(spark, sf_dir), "n_employees", model, matches=matches))


@query
def a01_scored_passages(spark, sf_dir):
    matches, model = _employees(spark, sf_dir)
    out = assess.flag_passages(matches, "n_employees", model)
    return out.select("filename", "page", "paragraph", rounded("likelihood"), "predicted_text_class")


def _marked(matches: DataFrame) -> DataFrame:
    """Matches with a class by a rule that stands in for a reader."""
    return matches.select("text", ((F.col("page") + F.col("paragraph")) % 3 != 0).cast("int").alias("class"))


def _category(matches: DataFrame) -> linear.LinearModel:
    """A category model of the matches on even pages; the reader does not count cover for fewer than three."""
    marked = matches.filter("page % 2 = 0").select("text", (~F.col("text").rlike("for [0-2] ")).cast("int").alias("class"))
    return linear.train_category(marked, alpha=0.01)


def _assess_query(metric: str) -> Query:
    """One metric over all reports; its model is trained on its own marked matches."""
    def run(spark, sf_dir):
        blocks = report_blocks(spark, sf_dir)
        matches = assess.report_matches(blocks, [metric])
        if metric in FREQUENT:
            model = None
        elif metric == "healthcare":
            model = _category(matches)
        else:
            model = (*naive_bayes.train(_marked(matches), 0.25), (1, 1))
        return _flat(assess.assess_metric(blocks, metric, model, matches=matches))
    return run


FREQUENT = ["ltifr", "trifr"]
ASSESSED = ["n_contractors", "healthcare", "ceo_pay_ratio", "trifr", "company_gender_diversity"]
for _m in ASSESSED:
    QUERIES[f"a06_assess_{_m}"] = _assess_query(_m)


@query
def a06_assess_all(spark, sf_dir):
    """All 13 metrics in one pass: one model of all marked matches, and a category model for healthcare."""
    blocks = report_blocks(spark, sf_dir)
    matches = assess.report_matches(blocks, list(METRICS))
    nb = (*naive_bayes.train(_marked(matches), 0.25), (1, 1))
    models = {m: nb for m in METRICS if m not in FREQUENT}
    models["healthcare"] = _category(matches.filter("metric = 'healthcare'"))
    return _flat(assess.assess_metrics(blocks, list(METRICS), models, matches=matches))


@query
def a07_assess_report(spark, sf_dir):
    """The first report with a match."""
    blocks = report_blocks(spark, sf_dir)
    name = assess.report_matches(blocks, ["ltifr"]).agg(F.min("filename")).first()[0]
    return _flat(assess.assess_report(blocks, name, "ltifr"))


@query
def a08_training_candidates(spark, sf_dir):
    return assess.training_candidates(report_blocks(spark, sf_dir), "n_employees", 80).drop("metric")
