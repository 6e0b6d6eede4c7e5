"""The metrics: keywords for pages, patterns for passages, and how passages are scored."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

Token = dict[str, Any]

# ---------------------------------------------------------------------------
# Keywords, token patterns and phrases of each metric. Misspelled
# and dead entries are part of the rules; override them with ``with_patterns``.
# ---------------------------------------------------------------------------
EMPLOYEE_WORDS = ["employee", "people", "person", "colleague", "team", "staff", "full-time", "fte"]
HEADCOUNT_WORDS = EMPLOYEE_WORDS + ["headcount", "workforce"]
ETHNIC_WORDS = ["ethnic", "bame", "non-white", "ethnically", "race", "racial", "minority"]

ANY = {"OP": "?"}
CARDINALS = {"ENT_TYPE": "CARDINAL", "OP": "+"}
NUMBERS = {"LIKE_NUM": True, "OP": "+"}
SYMBOLS = {"POS": "SYM", "OP": "*"}
SYMBOL = {"POS": "SYM", "OP": "?"}


def lemma(*words: str, op: str | None = None) -> Token:
    return _word_token("LEMMA", words, op)


def lower(*words: str, op: str | None = None) -> Token:
    return _word_token("LOWER", words, op)


def _word_token(attribute: str, words: tuple[str, ...], op: str | None) -> Token:
    token: Token = {attribute: words[0] if len(words) == 1 else {"IN": list(words)}}
    if op:
        token["OP"] = op
    return token


N_EMPLOYEES = [
    [lemma("total", "average"), ANY, ANY, lemma("number", op="?"), lemma("of", op="+"), lemma(*EMPLOYEE_WORDS)],
    [lemma("employ", "hire"), ANY, ANY, ANY, ANY, CARDINALS, lemma(*EMPLOYEE_WORDS), {"POS": "NOUN", "OP": "?"}],
    [lemma("the", "our", "with", "have"), {"POS": "ADP", "OP": "?"}, {"POS": "ADP", "OP": "?"}, CARDINALS,
     lemma(*HEADCOUNT_WORDS)],
    [lemma("total", "average"), lemma(*HEADCOUNT_WORDS)],
    [lemma("with", "have"), lemma("headcount", "team", "workforce", "staff"), lemma("of"), {"ENT_TYPE": "CARDINAL"}],
    [lemma("there"), lemma("be"), {"ENT_TYPE": "CARDINAL"}, lemma(*EMPLOYEE_WORDS)],
    [{"ENT_TYPE": "CARDINAL"}, lemma(*EMPLOYEE_WORDS), lemma("work")],
]
N_CONTRACTORS = [
    [{"ENT_TYPE": {"IN": ["CARDINAL", "PERCENT"]}}, lemma("employee", op="!"), ANY, ANY, ANY, ANY, lemma("contractor")],
    [lemma("contractor"), ANY, ANY, ANY, ANY, {"ENT_TYPE": {"IN": ["CARDINAL", "PERCENT"]}}],
    [lemma("number"), lemma("employee", op="!"), ANY, ANY, ANY, ANY, lemma("contractor")],
]
GENDER_DIVERSITY = [
    [lower("gender", op="+"), lower("diversity", "equality", "balance", "split", "breakdown", op="+")],
    [lower("by", "across", op="+"), lower("gender", op="+")],
    [NUMBERS, SYMBOLS, ANY, ANY, ANY, lemma("female")],
]
N_FATALITIES = [
    [lemma("tragically", "tragic", "sadly", "regret", " regrettably"), {"OP": "*"}, lemma("fatality")],
    [CARDINALS, {"OP": "*"}, lemma("fatality", "die")],
    [lemma("number"), {"OP": "*"}, lemma("fatality", "die", "death", "casualty")],
    [lemma("safety"), {"OP": "*"}, lemma("fatality", "die", "death", "casualty")],
]
ETHNIC_DIVERSITY = [
    [lemma(*ETHNIC_WORDS), ANY, ANY, ANY, NUMBERS, SYMBOL],
    [NUMBERS, SYMBOLS, ANY, ANY, ANY, lemma(*ETHNIC_WORDS)],
    [lower("black"), lower("asian"), lower("and", op="?"), lower("minority"), lemma("ethnic"), ANY, ANY, ANY,
     NUMBERS, SYMBOL],
    [NUMBERS, SYMBOL, ANY, ANY, ANY, lower("black"), lower("asian"), lower("and", op="?"), lower("minority"),
     lemma("ethnic")],
    [lower("of"), lower("colour", "color"), ANY, ANY, ANY, NUMBERS, SYMBOLS],
    [NUMBERS, SYMBOLS, ANY, ANY, ANY, lower("of"), lower("colour", "color")],
    [lower("board", op="?"), lemma("ethnic", "ethnicity"), ANY, ANY, {"TEXT": {"REGEX": "([Dd]iversity|)"}}],
    [lower("non", op="?"), SYMBOL, lower("bame"), ANY, {"LIKE_NUM": True, "OP": "?"}, SYMBOL],
    [lower("parker"), lower("review")],
]
INTERNATIONAL_DIVERSITY = [
    [{"ENT_TYPE": "CARDINAL", "OP": "?"}, lemma("nationality", "country", op="+"),
     lemma("represent", "serve", "employ", op="+")],
    [lemma("represent", "serve", "employ", op="+"), CARDINALS, lemma("nationality", "country", op="+")],
    [lower("by", "across", op="+"), lemma("nationality", op="+")],
    [lower("nationality", op="+"), {"IS_PUNCT": True, "OP": "?"},
     {"ENT_TYPE": {"IN": ["NORP", "GPE", "CARDINAL"]}, "OP": "+"}],
    [lower("board", "employee", "executive", "non-executive", "colleague", "workforce", "committee", op="+"),
     {"OP": "*"}, lemma("nationality", op="+")],
]
HEALTHCARE = [
    [lower("medical", "health", "healthcare", "health care", "life", op="+"),
     lower("insurance", "benefits", "scheme", "assurance", "cover", "protection", op="+"),
     {"LOWER": {"NOT_IN": ["limited", "business", "no", "co", "ltd", "risk", "liabilites", "company", "products"]},
      "OP": "+"}],
]
PARENTAL_CARE = ["mother", "maternity", "paternity", "parental", "family care", "family benefits"]
LTIFR = ["Lost-time injury frequency rate", "Lost time injury frequency rate", "Lost time injury and illness rate",
         "LTIFR", "LTIIR"]
TRIFR = ["TOTAL RECORDABLE INJURY FREQUENCY RATE", "TRIFR", "Total Recordable Frequency Rate", "TRFR",
         "Total recordable injury frequency", "TRIF", "Total reportable injury (TRI) rate",
         "Total recordable case frequency", "TRCF", "Total recordable case frequency rate", "TRCFR",
         "Total recordable injury and illness rate", "TRIIR", "Total Recordable Incident Rate", "TRIR",
         "Total recordable case rate", "TRCR"]
CEO_PAY_RATIO = ["pay ratio", "pay ratios", "ceo pay", "chief executive pay", "renumeration", "pay for the ceo"]

GENDER_KEYWORDS = ["female", "divers", "gender", "male", "women"]
ETHNIC_KEYWORDS = ["divers", "representation", "ethnic", "bame"]

# Limits of the scorers.
BEST_PAGE_LIKELIHOOD = 0.6
CATEGORY_PROBABILITY = 0.7


@dataclass(frozen=True)
class Metric:
    """``kind`` is ``text`` (token patterns) or ``phrase``; ``scorer`` is
    ``best_page``, ``frequent_page``, ``predict`` or ``category``."""

    name: str
    keywords: list[str]
    kind: str
    patterns: list[Any]
    scorer: str


_METRICS = [
    Metric("n_employees", ["employ", "team", "workforce", "colleague", "staff", "headcount"], "text", N_EMPLOYEES,
           "best_page"),
    Metric("n_contractors", ["contractor"], "text", N_CONTRACTORS, "predict"),
    Metric("company_gender_diversity", GENDER_KEYWORDS, "text", GENDER_DIVERSITY, "predict"),
    Metric("board_gender_diversity", GENDER_KEYWORDS, "text", GENDER_DIVERSITY, "predict"),
    Metric("n_fatalities", ["fatal", "died", "death", "mortal", "casualt", "dead"], "text", N_FATALITIES, "predict"),
    Metric("company_ethnic_diversity", ETHNIC_KEYWORDS, "text", ETHNIC_DIVERSITY, "predict"),
    Metric("board_ethnic_diversity", ETHNIC_KEYWORDS, "text", ETHNIC_DIVERSITY, "predict"),
    Metric("international_diversity", ["national", "diversity", "countr"], "text", INTERNATIONAL_DIVERSITY, "predict"),
    Metric("healthcare", ["healthcare", "health", "life", "medical"], "text", HEALTHCARE, "category"),
    Metric("ceo_pay_ratio", ["pay ratio", "ratios", "pay", "ceo pay", "remuneration"], "phrase", CEO_PAY_RATIO,
           "best_page"),
    Metric("parental_care", ["mother", "maternity", "paternity", "family"], "phrase", PARENTAL_CARE, "predict"),
    Metric("ltifr", ["accidents", "injury", "ltifr", "lost-time injury", "lost time injury"], "phrase", LTIFR,
           "frequent_page"),
    Metric("trifr", ["trir", "injury", "trcfr", "trifr", "triir", "trif", "total recordable", "total reportable"],
           "phrase", TRIFR, "frequent_page"),
]
METRICS: dict[str, Metric] = {m.name: m for m in _METRICS}


def get_metric(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric]


def get_keywords(metric: str | list[str] | Metric) -> list[str]:
    """Keywords of a metric, or the given list itself."""
    return list(metric) if isinstance(metric, list) else get_metric(metric).keywords


def get_patterns(metric: str | Metric) -> list[Any]:
    if isinstance(metric, list):
        raise ValueError("a keyword list has no patterns; name a metric")
    return get_metric(metric).patterns


def with_patterns(metric: str | Metric, patterns: list[Any], keywords: list[str] | None = None) -> Metric:
    """A copy of a metric with other patterns, e.g. with spelling corrected."""
    base = get_metric(metric)
    return replace(base, patterns=patterns, keywords=keywords or base.keywords)


def keyword_table(spark):
    """The registry as a DataFrame ``metric, kind, scorer, keyword``."""
    rows = [(m.name, m.kind, m.scorer, k) for m in METRICS.values() for k in m.keywords]
    return spark.createDataFrame(rows, "metric string, kind string, scorer string, keyword string")
