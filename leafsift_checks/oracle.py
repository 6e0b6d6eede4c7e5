"""The same results as DuckDB SQL, stated with windows and lists instead of the operators."""

from __future__ import annotations

from leafsift.functions.words import PRONOUNS, STOP_WORDS, SYMBOLS
from leafsift.operators import tokens as T
from leafsift.plans.registry import METRICS, get_keywords
from leafsift.plans.training import NB_ALPHA, NGRAM_HIGHS, SGD_ALPHA, SVC_C
from leafsift_checks import token_patterns as P
from leafsift_checks.derived import report_blocks_sql
from leafsift_checks.queries import ADHOC, ASSESSED, FREE, LONG_PHRASES

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str) -> str:
    """Java's possessive loops in RE2, which needs none."""
    return regex.replace("*+", "*")


def qlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
HARD = rf"[^{WS}]\n(\p{{Nd}}|[^\p{{L}}\p{{N}}_])"
SOFT = rf"[{WS}]\n[\p{{Nd}}{WS}]"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q(rf'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def squash(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {q(rf'[{WS}]+')}, ' ', 'g'), '[^ -~]', ' ', 'g')"


def words_of(raw: str) -> str:
    return strip(f"array_to_string(list_filter(string_split({raw}, chr(10)), lambda x: regexp_matches(x, '^[a-zA-Z]')), ' ')")


def ctes(*parts: tuple[str, str]) -> str:
    # A body that several others read is marked, so that it is computed once.
    recursive = "RECURSIVE " if any("USING KEY" in name for name, _ in parts) else ""
    return f"WITH {recursive}" + ",\n".join(
        f"{name} AS {'MATERIALIZED ' if body.startswith('/*M*/') else ''}({body.removeprefix('/*M*/')})" for name, body in parts) + "\n"


# --- blocks ------------------------------------------------------------------
B = ("b", report_blocks_sql())
D = ("d", """SELECT filename, CAST((i - 1) // 4 + 1 AS INT) AS page, CAST((i - 1) % 4 + 1 AS INT) AS paragraph, text FROM (
  SELECT source || '_' || doc_id || '_Annual_Report_' || (2000 + doc_id % 20) || '.pdf' AS filename,
         unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
TABLES = ("t", f"""SELECT *, CAST(row_number() OVER (PARTITION BY filename ORDER BY page, paragraph) AS INT) AS table_no,
  paragraph - row_number() OVER (PARTITION BY filename, page ORDER BY paragraph) AS island
  FROM b WHERE {count('text', HARD)} >= 4 OR {count('text', SOFT)} >= 3""")
JOINED = ("j", f"""SELECT filename, page, paragraph, raw,
    CAST(row_number() OVER (PARTITION BY filename ORDER BY page, paragraph) AS INT) AS joined_no,
    count(*) OVER (PARTITION BY filename) AS n_joined
  FROM (SELECT filename, page, min(paragraph) AS paragraph, string_agg(text, chr(10) ORDER BY paragraph) AS raw
        FROM (SELECT *, row_number() OVER (PARTITION BY filename, page, island ORDER BY paragraph) AS k FROM t)
        WHERE k = 1 OR NOT regexp_matches(text, {q(rf'^[{WS}]+$')})
        GROUP BY filename, page, island)""")


def substituted(keep_last: bool = False) -> tuple[str, str]:
    rule = "" if keep_last else "WHERE joined_no < n_joined"
    return ("sub", f"""SELECT filename, page, paragraph, text FROM b
      WHERE NOT ({count('text', HARD)} >= 4 OR {count('text', SOFT)} >= 3)
      UNION ALL SELECT filename, page, paragraph, '<TABLE ' || joined_no || ' CONTENTS(' || {words_of('raw')} || ') ENDTABLE>' FROM j {rule}""")


def not_junk(text: str = "text") -> str:
    marks = ["'<image:'", "'.indd'", "chr(65533)", "chr(61623)", "chr(8211)"]
    return f"{text} <> '' AND " + " AND ".join(f"NOT contains({text}, {m})" for m in marks)


CLEAN = ("c", f"SELECT filename, page, paragraph, {squash('text')} AS text FROM sub WHERE {not_junk()}")
CLEANED = [B, TABLES, JOINED, substituted(), CLEAN]

ORACLE["s02_blocks_from_text"] = ctes(D) + "SELECT * FROM d"
_TAGS = r"(?i)</?(p|div|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|nav|br|footer|header|section|article)\b[^>]*>"
_body = "html"
for _p in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
    _body = f"regexp_replace({_body}, {q(_p)}, '', 'g')"
_body = f"regexp_replace(regexp_replace({_body}, {q(_TAGS)}, chr(1), 'g'), '<[^>]*>', '', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _body = f"replace({_body}, {q(_e)}, {q(_c)})"
ORACLE["s02_blocks_from_html"] = f"""SELECT filename, CAST((i - 1) // 4 + 1 AS INT) AS page, CAST((i - 1) % 4 + 1 AS INT) AS paragraph, text FROM (
  SELECT 'Page_' || page_id AS filename, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (
    SELECT page_id, list_filter(string_split({_body}, chr(1)), lambda x: regexp_matches(x, '[^ \\n\\r\\t]')) AS l FROM pages))"""
ORACLE["s02_blocks_from_turns"] = """SELECT 'Talk_' || conv_id AS filename, CAST(turn + 1 AS INT) AS page,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS paragraph, unnest(string_split(text, chr(10))) AS text FROM conversations"""
_NAMES = ("n", """SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN source || '.pdf'
   ELSE source || '_Group_plc_Annual_Report_' || doc_id || '.v2.pdf' END AS filename FROM documents""")
ORACLE["s03_report_metadata"] = ctes(_NAMES) + """SELECT filename, replace(split_part(filename, '_Annual_Report_', 1), '_', ' ') AS name,
  'Annual Report' AS type, split_part(split_part(filename, '_Annual_Report_', 2), '.', 1) AS year
  FROM n WHERE contains(filename, '_Annual_Report_')"""
ORACLE["s03_quarantined_reports"] = ctes(_NAMES) + "SELECT filename, 'Annual Report' AS type FROM n WHERE NOT contains(filename, '_Annual_Report_')"
ORACLE["s04_labelled_passages"] = "SELECT text, CAST(toxic AS INT) AS class FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL"
ORACLE["s04_labelled_lines"] = """SELECT translate(text, chr(10) || chr(13), '  ') AS text, CAST(toxic AS INT) AS class
  FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL"""
ORACLE["s07_first_reports"] = ctes(D) + """SELECT filename, count(*) AS n_blocks, max(page) AS pages FROM d
  WHERE filename IN (SELECT DISTINCT filename FROM d ORDER BY filename LIMIT 80) GROUP BY filename"""

# --- cleaning ----------------------------------------------------------------
ORACLE["c01_count_characters"] = ctes(D) + f"SELECT filename, CAST(sum({count('text', chr(92) + 'p{Nd}+')}) AS BIGINT) AS n FROM d GROUP BY filename"
ORACLE["c02_audit_characters"] = ctes(B) + f"""SELECT filename, n_bad, n_chars, round(100.0::DOUBLE * n_bad / n_chars, 6) AS pct_bad FROM (
  SELECT filename, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS n_bad,
         CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS n_chars FROM b GROUP BY filename)"""
_SIG = "round_even(price * pow(10.0, {d} - 1 - floor(log10(price))), 0) / pow(10.0, {d} - 1 - floor(log10(price)))"
ORACLE["c03_round_significant"] = f"""SELECT l_orderkey, {_SIG.format(d=2)} AS two, {_SIG.format(d=4)} AS four
  FROM (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey)"""
ORACLE["c04_find_tables"] = ctes(B, TABLES) + "SELECT filename, table_no, page, paragraph, text AS raw_table_text FROM t"
ORACLE["c05_stitch_tables"] = ctes(B, TABLES, JOINED) + "SELECT filename, joined_no AS table_no, page, paragraph, raw AS raw_table_text FROM j"
ORACLE["c06_table_words"] = ctes(B) + f"SELECT filename, page, paragraph, {words_of('text')} AS words FROM b"
ORACLE["c07_substitute_tables"] = ctes(B, TABLES, JOINED, substituted()) + "SELECT * FROM sub"
ORACLE["c07_keep_last_table"] = ctes(B, TABLES, JOINED, substituted(True)) + "SELECT * FROM sub"
ORACLE["c08_without_tables"] = ctes(B, TABLES, JOINED, substituted()) + "SELECT * FROM sub WHERE text NOT LIKE '<TABLE%'"
ORACLE["c09_drop_junk"] = ctes(B) + f"SELECT * FROM b WHERE {not_junk()}"
ORACLE["c10_normalise"] = ctes(D) + f"SELECT filename, page, paragraph, {squash('text')} AS text FROM d"
ORACLE["c11_clean_blocks"] = ctes(*CLEANED) + "SELECT * FROM c"
ORACLE["c11_pages_after_cleaning"] = ctes(*CLEANED) + """SELECT b.filename, b.page, count(*) AS n_before, count(c.paragraph) AS n_after
  FROM b LEFT JOIN c ON b.filename = c.filename AND b.page = c.page AND b.paragraph = c.paragraph GROUP BY b.filename, b.page"""
ORACLE["c12_table_cells"] = ctes(B, TABLES, ("s", f"""
   SELECT filename, table_no, brk, l[:-2] AS l FROM (SELECT filename, table_no, string_split(text, chr(10)) AS l,
     regexp_extract_all(text, {q(rf'[^{WS}]' + chr(92) + rf'n[^{WS}]')}) AS brk FROM t) WHERE len(brk) > 0"""),
  ("m", """SELECT filename, table_no, l, coalesce(list_position(list_transform(brk, lambda x: regexp_matches(x, '\\n\\p{Nd}')), true), len(brk)) - 1 AS n FROM s"""),
  ("e", "SELECT *, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS idx FROM m")) + """
SELECT filename, table_no, CAST((idx - n) // (n + 1) AS INT) AS row_no, CAST((idx - n) % (n + 1) AS INT) AS col_no,
  CASE WHEN (idx - n) % (n + 1) = 0 THEN 'Index' ELSE l[(idx - n) % (n + 1)] END AS header, value,
  (len(l) - n) % (n + 1) <> 0 AS is_ragged FROM e WHERE idx >= n"""

# --- page selection ------------------------------------------------------------


def hit_pages(source: str, keywords) -> str:
    return f"""SELECT filename, page FROM {source} GROUP BY filename, page
      HAVING regexp_matches(lower(string_agg(text, ' ' ORDER BY paragraph)), {q('|'.join(keywords))}, 's')"""


def selected(source: str, keywords) -> str:
    return f"SELECT s.* FROM {source} s SEMI JOIN ({hit_pages(source, keywords)}) h ON s.filename = h.filename AND s.page = h.page"


ORACLE["p01_select_pages"] = ctes(*CLEANED) + selected("c", get_keywords("n_employees"))
ORACLE["p01_select_pages_across_blocks"] = ctes(*CLEANED) + selected("c", get_keywords("trifr"))
ORACLE["p03_long_phrases"] = ctes(*CLEANED) + selected("c", LONG_PHRASES)
ORACLE["p03_adhoc_keywords"] = ctes(D) + selected("d", ADHOC)
ORACLE["p03_adhoc_regex"] = ctes(*CLEANED) + selected("c", FREE)
_PAGES = ("pg", "SELECT filename, page, lower(string_agg(text, ' ' ORDER BY paragraph)) AS text FROM c GROUP BY filename, page")
ORACLE["p02_keyword_hits"] = ctes(*CLEANED, _PAGES) + " UNION ALL ".join(
    f"SELECT {q(k)} AS keyword, count(*) AS pages FROM pg WHERE contains(text, {q(k)}) HAVING count(*) > 0"
    for k in dict.fromkeys(k for m in METRICS for k in get_keywords(m)))
ORACLE["p04_many_metrics"] = ctes(*CLEANED, _PAGES) + " UNION ALL ".join(
    f"SELECT filename, page, {q(m)} AS metric FROM pg WHERE regexp_matches(text, {q('|'.join(get_keywords(m)))})" for m in METRICS)

# --- tokens and matches ----------------------------------------------------------
# Word forms that no rule gives, by lemma.
_FORMS = {"am is are was were been being ''s ''m ''re": "be", "has had having ''ve": "have", "does did done doing": "do", "died dies dying": "die",
          "lies lied lying": "lie", "goes going gone went": "go", "seeing seen saw": "see", "agreed agreeing": "agree", "created creating": "create",
          "added adding": "add", "regrets regretted regretting": "regret", "totals totalled totalling totaled totaling": "total",
          "invited inviting": "invite", "men": "man", "women": "woman", "children": "child", "peoples": "people", "buses": "bus",
          "businesses": "business", "processes": "process", "mornings": "morning", "evenings": "evening", "ceilings": "ceiling", "siblings": "sibling"}
_KEPT = ("this gas always species series during morning evening ceiling sibling nothing something anything everything hundred sacred naked "
         "wicked")


def lemma_sql(x: str) -> str:
    """Lemma of a lower-cased word, rule by rule, the longest suffix first."""
    forms = " ".join(f"WHEN {x} IN ({', '.join(chr(39) + f + chr(39) for f in forms.split())}) THEN '{lemma}'" for forms, lemma in _FORMS.items())
    cut = lambda n, add="": f"left({x}, length({x}) - {n})" + (f" || '{add}'" if add else "")
    has = lambda r: f"regexp_matches({x}, '{r}')"
    e = ("([^eo]at|iz|is|[aeo]s|[^c]us|ns|rs|[aeiou]c|nc|rc|v|u|dg|rg|ag|[ae]ng|[bcdfgkptz]l|[^aeiou][iu]r|quir|plor|stor|[pl]ar|[vcsu]id|lud|rud|"
         "[bmfg]in|[bcp]ut|let|mot|vot|quot|vok)")
    verb = " ".join(f"""WHEN {x} LIKE '%{end}' THEN CASE WHEN {has(f'[aeiouy][a-z]*{end}$')} AND {x} NOT LIKE '%eed' THEN CASE
        WHEN {has(f'(bb|dd|gg|mm|nn|pp|rr|tt){end}$')} THEN {cut(len(end) + 1)}
        WHEN {has(f'{e}{end}$')} OR {has(f'^[^aeiou]*[aeiou][^aeiouwxy]{end}$')} THEN {cut(len(end), 'e')}
        WHEN length({x}) > {len(end) + 2} THEN {cut(len(end))} ELSE {x} END ELSE {x} END""" for end in ("ing", "ed"))
    return f"""CASE {forms} WHEN {x} IN {qlist(_KEPT.split())} OR NOT {has('^[a-z]+$')} THEN {x}
        WHEN {has('..iest$')} THEN {cut(4, 'y')} WHEN {x} LIKE '%iest' THEN {x}
        WHEN {has('..(ies|ied)$')} THEN {cut(3, 'y')} WHEN {has('(ies|ied)$')} THEN {x}
        WHEN {has('.(ss|sh|ch|x|z)es$')} THEN {cut(2)} WHEN {has('(ss|sh|ch|x|z)es$')} THEN {x}
        WHEN {has('.(bb|dd|gg|mm|nn|pp|rr|tt)est$')} THEN {cut(4)} WHEN {x} LIKE '%est' THEN {x}
        {verb}
        WHEN {has('.[^siu]s$')} THEN {cut(1)} ELSE {x} END"""


TOKENS = [
    ("r", f"SELECT filename, page, paragraph, text, regexp_extract_all(text, {q(re2(T.TOKEN))}, 1) AS raw FROM c"),
    ("tk0", "SELECT filename, page, paragraph, unnest(raw) AS t, generate_subscripts(raw, 1) AS i FROM r"),
    ("tk1", f"""SELECT *, lower(tx) AS lo, regexp_matches(lower(tx), {q(re2(T.NUMERAL))}) OR lower(tx) IN {qlist(T.NUMBER_WORDS)} AS num
       FROM (SELECT *, CASE WHEN t LIKE ' %' THEN t ELSE rtrim(t, ' ') END AS tx FROM tk0)"""),
    ("tk2", """SELECT *, lead(lo) OVER w AS nx, lag(lo) OVER w AS pv, coalesce(lag(num) OVER w, false) AS pvnum FROM tk1
       WINDOW w AS (PARTITION BY filename, page, paragraph ORDER BY i)"""),
    ("tk", f"""SELECT *, {lemma_sql('lo')} AS lemma,
        CASE WHEN num AND nx IN ('%', 'percent') THEN 'P' WHEN lo IN ('%', 'percent') AND pvnum THEN 'P'
             WHEN num AND pv IN {qlist(T.CURRENCIES)} THEN 'M' WHEN num THEN 'C' WHEN lo IN {qlist(T.COUNTRIES)} THEN 'G'
             WHEN lo IN {qlist(T.PEOPLES)} THEN 'R' ELSE 'O' END AS ent,
        CASE WHEN num THEN 'd' WHEN lo IN {qlist(T.ADPOSITIONS)} THEN 'a' WHEN lo IN {qlist(T.SYMBOLS)} THEN 's'
             WHEN lo IN {qlist(T.PUNCTUATION)} THEN 'p' WHEN lo LIKE ' %' THEN 'w'
             WHEN regexp_matches(lo, '({"|".join(T.NOUN_ENDINGS)})$') THEN 'n' ELSE 'x' END AS pos,
        lo IN {qlist(T.PUNCTUATION)} AS pun FROM tk2"""),
    ("enc", """SELECT filename, page, paragraph, string_agg(chr(1) || lo || chr(2) || lemma || chr(3) || pos || ent ||
          CASE WHEN num THEN 'N' ELSE '' END || CASE WHEN pun THEN 'U' ELSE '' END || chr(4) || tx, '' ORDER BY i) AS e
       FROM tk GROUP BY filename, page, paragraph"""),
]
ORACLE["m01_annotate_tokens"] = ctes(*CLEANED, *TOKENS) + """SELECT filename, page, paragraph,
   translate(e, chr(1) || chr(2) || chr(3) || chr(4), chr(10) || '|/~') AS encoded FROM enc"""
# Patterns with negated tokens, stated on token rows: where each match starts, its length, the pattern's number.
_KEY = "a.filename = z.filename AND a.page = z.page AND a.paragraph = z.paragraph"
_CONTRACTORS = f"""SELECT a.filename, a.page, a.paragraph, a.i - 1 AS st, z.i - a.i + 1 AS n,
     CASE WHEN a.lemma = 'contractor' THEN 1 WHEN a.ent IN ('C', 'P') THEN 0 ELSE 2 END AS pat
   FROM tk a JOIN tk z ON {_KEY}
   LEFT JOIN tk y ON a.filename = y.filename AND a.page = y.page AND a.paragraph = y.paragraph AND y.i = a.i + 1
   WHERE ((a.ent IN ('C', 'P') OR a.lemma = 'number') AND z.lemma = 'contractor' AND z.i - a.i BETWEEN 2 AND 6 AND y.lemma <> 'employee')
      OR (a.lemma = 'contractor' AND z.ent IN ('C', 'P') AND z.i - a.i BETWEEN 1 AND 5)"""
# A run of the first words, one of the second, any other than the third: the run's first word is where it starts.
_HEALTH = f"""SELECT a.filename, a.page, a.paragraph, a.i - a.run AS st, a.run + 2 AS n, 0 AS pat
   FROM (SELECT *, row_number() OVER (PARTITION BY filename, page, paragraph, i - k ORDER BY i) AS run FROM (
     SELECT *, row_number() OVER (PARTITION BY filename, page, paragraph ORDER BY i) AS k FROM tk
     WHERE lo IN ('medical', 'health', 'healthcare', 'health care', 'life'))) a
   JOIN tk z ON {_KEY} AND z.i = a.i + 1
   JOIN tk y ON a.filename = y.filename AND a.page = y.page AND a.paragraph = y.paragraph AND y.i = a.i + 2
   WHERE z.lo IN ('insurance', 'benefits', 'scheme', 'assurance', 'cover', 'protection')
     AND y.lo NOT IN ('limited', 'business', 'no', 'co', 'ltd', 'risk', 'liabilites', 'company', 'products')"""
NEGATED = {"n_contractors": _CONTRACTORS, "healthcare": _HEALTH}


def _hits(metric: str) -> list[str]:
    """For each pattern of a metric, the number of blocks it hits."""
    m = METRICS[metric]
    if metric in NEGATED:
        return [f"(SELECT count(DISTINCT (filename, page, paragraph)) FROM ({NEGATED[metric]}) WHERE pat = {i}) AS {metric}_{i}" for i in range(len(m.patterns))]
    return [f"(SELECT count(*) FROM enc WHERE regexp_matches(e, {q(r)})) AS {metric}_{i}" for i, r in enumerate(P.compile_patterns(m.patterns, m.kind))]


ORACLE["m02_pattern_hits"] = ctes(*CLEANED, *TOKENS) + "SELECT " + ", ".join(h for m in METRICS for h in _hits(m))


def match_ctes(metric: str, name: str = "mt") -> list[tuple[str, str]]:
    """First match per block on selected pages: lowest start, shortest, pattern order."""
    m = METRICS[metric]
    per = "" if metric in NEGATED else " UNION ALL ".join(
        f"SELECT filename, page, paragraph, e, regexp_extract(e, {q(r)}) AS mm, {i} AS pat FROM enc WHERE regexp_matches(e, {q(r)})"
        for i, r in enumerate(P.compile_patterns(m.patterns, m.kind)))
    places = f"SELECT *, len(string_split(left(e, strpos(e, mm) - 1), chr(1))) - 1 AS st, len(string_split(mm, chr(1))) - 1 AS n FROM ({per})"
    return [
        (name + "0", NEGATED.get(metric, places)),
        (name + "1", f"SELECT filename, page, paragraph, min((st, n, pat)) AS f FROM {name}0 GROUP BY ALL"),
        (name + "h", hit_pages("c", m.keywords)),
        (name, f"""SELECT r.filename, replace(split_part(r.filename, '_Annual_Report_', 1), '_', ' ') AS name,
            split_part(split_part(r.filename, '_Annual_Report_', 2), '.', 1) AS year, r.page, r.paragraph, r.text,
            rtrim(array_to_string(raw[f[1] + 1 : f[1] + f[2]], ''), ' ') AS match_string,
            CAST(f[1] AS INT) AS start, CAST(f[1] + f[2] AS INT) AS "end"
          FROM r JOIN {name}1 x ON r.filename = x.filename AND r.page = x.page AND r.paragraph = x.paragraph
          SEMI JOIN {name}h h ON r.filename = h.filename AND r.page = h.page"""),
    ]


def match_sql(metric: str) -> str:
    return ctes(*CLEANED, *TOKENS, *match_ctes(metric)) + "SELECT * FROM mt"


for _m in ("n_employees", "company_gender_diversity", "n_fatalities", "company_ethnic_diversity", "international_diversity"):
    ORACLE[f"m06_match_table_{_m}"] = match_sql(_m)
for _m in ("ltifr", "trifr", "ceo_pay_ratio", "parental_care"):
    ORACLE[f"m04_phrase_match_{_m}"] = match_sql(_m)

ORACLE["s05_match_table"] = match_sql("ltifr")

for _m in NEGATED:
    ORACLE[f"m03_token_match_{_m}"] = match_sql(_m)


def _found(metric: str) -> str:
    if metric in NEGATED:
        body = f"SELECT DISTINCT filename, page, paragraph FROM ({NEGATED[metric]})"
    else:
        m = METRICS[metric]
        anyof = "|".join(f"({r})" for r in P.compile_patterns(m.patterns, m.kind))
        body = f"SELECT filename, page, paragraph FROM enc WHERE regexp_matches(e, {q(anyof)})"
    return f"""SELECT {q(metric)} AS metric, {q(METRICS[metric].kind)} AS kind, count(*) AS matches, count(DISTINCT filename) AS reports
      FROM ({body}) x SEMI JOIN ({hit_pages('c', get_keywords(metric))}) h ON x.filename = h.filename AND x.page = h.page HAVING count(*) > 0"""


ORACLE["m05_matches_by_metric"] = ctes(*CLEANED, *TOKENS) + " UNION ALL ".join(_found(m) for m in METRICS)

# --- ranking -----------------------------------------------------------------------
_SC = ("sc", """SELECT filename, CAST(page // 3 AS INT) AS page, page * 10 + paragraph AS paragraph,
   CAST((page * 31 + paragraph * 7) % 20 AS DOUBLE) / 20.0::DOUBLE AS likelihood FROM b""")


def best(source: str) -> str:
    return f"""SELECT filename, page, n, likelihood FROM (SELECT filename, page, count(*) AS n, max(likelihood) AS likelihood
       FROM {source} WHERE likelihood > 0.6 GROUP BY filename, page)
       QUALIFY row_number() OVER (PARTITION BY filename ORDER BY n DESC, round(likelihood, 9) DESC, page) = 1"""


ORACLE["r01_winning_pages"] = ctes(B, _SC) + best("sc")
ORACLE["r01_best_page"] = ctes(B, _SC, ("w", best("sc"))) + """SELECT sc.*, CAST(w.page IS NOT NULL AND sc.likelihood > 0.6 AS INT) AS predicted_text_class
   FROM sc LEFT JOIN w ON sc.filename = w.filename AND sc.page = w.page"""


def frequent(source: str) -> str:
    return f"""SELECT *, CAST(n = max(n) OVER (PARTITION BY filename) AS INT) AS predicted_text_class
       FROM (SELECT *, count(*) OVER (PARTITION BY filename, page) AS n FROM {source})"""


ORACLE["r02_frequent_pages"] = ctes(B, _SC, ("f", frequent("sc"))) + "SELECT filename, page, paragraph, predicted_text_class FROM f"

# --- classification ------------------------------------------------------------------
WORD = r"\p{Nd}+(?:[.,]\p{Nd}+)*|[\p{L}\p{M}\p{N}_]+|\.{3}|[^\s\x0b\p{Z}\p{L}\p{M}\p{N}_]"


def cleaned_text(text: str) -> str:
    return f"lower(translate({strip(text)}, chr(10) || chr(13), '  '))"


def word_list(text: str, pronouns: bool = True) -> str:
    """Lemmas of the words; pronouns stay or go."""
    lemma = f"CASE WHEN x IN {qlist(PRONOUNS)} THEN x ELSE {lemma_sql('x')} END"
    gone = STOP_WORDS + SYMBOLS + ([] if pronouns else PRONOUNS)
    return f"list_filter(list_transform(regexp_extract_all({cleaned_text(text)}, {q(WORD)}), lambda x: {lemma}), lambda x: x NOT IN {qlist(gone)})"


DW = ("dw", f"SELECT doc_id, {word_list('text')} AS w FROM documents")
ORACLE["t01_clean_text"] = f"SELECT doc_id, {cleaned_text('text')} AS text FROM documents"
ORACLE["t02_tokenise"] = ctes(DW) + "SELECT doc_id, array_to_string(w, chr(10)) AS words, CAST(len(w) AS INT) AS n FROM dw"
ORACLE["t03_joined_words"] = f"SELECT doc_id, array_to_string({word_list('text', False)}, ' ') AS text FROM documents"


def grams(source: str, high: int, keys: str = "doc_id") -> str:
    parts = [f"SELECT {keys}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS term FROM {source}"
             for n in range(1, high + 1)]
    return f"SELECT {keys}, term, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY {keys}, term"


def weights(source: str, keys: str = "doc_id") -> str:
    return f"SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS w FROM {source}"


ORACLE["t04_ngram_counts"] = ctes(DW, ("g", grams("dw", 3))) + "SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM g GROUP BY term"
ORACLE["t05_l2_weights"] = ctes(DW, ("g", grams("dw", 1)), ("x", weights("g"))) + "SELECT doc_id, term, n, round(w, 6) AS w FROM x"
LAB = ("lab", "SELECT doc_id, text, toxic AS class FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")


def model_ctes(train: str, keys: str, high: int, alpha: float) -> list[tuple[str, str]]:
    """Naive Bayes tables from ``train (keys, text, class)``."""
    return [
        ("tw", f"SELECT {keys}, class, {word_list('text')} AS w FROM {train}"),
        ("tg", grams("tw", high, keys + ", class")),
        ("tx", weights("tg", keys)),
        ("f", "SELECT term, sum(CASE WHEN class = 0 THEN w ELSE 0 END) AS f0, sum(CASE WHEN class = 1 THEN w ELSE 0 END) AS f1 FROM tx GROUP BY term"),
        ("s", "SELECT sum(f0) AS s0, sum(f1) AS s1, count(*) AS v FROM f"),
        ("pr", f"SELECT ln(count(*) FILTER (class = 0) / count(*)) AS p0, ln(count(*) FILTER (class = 1) / count(*)) AS p1, "
               f"count(*) FILTER (class = 0) AS n0, count(*) FILTER (class = 1) AS n1 FROM {train}"),
        ("th", f"SELECT term, ln(f0 + {alpha}) - ln(s0 + {alpha} * v) AS theta0, ln(f1 + {alpha}) - ln(s1 + {alpha} * v) AS theta1 FROM f, s"),
    ]


def score_ctes(passages: str, keys: list[str], high: int) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    on = " AND ".join(f"p.{c} = z.{c}" for c in keys)
    return [
        ("sw", f"SELECT {k}, {word_list('text')} AS w FROM {passages}"),
        ("sg", grams("sw", high, k)),
        ("sz", f"SELECT {k}, sum(n * theta0) / sqrt(sum(n * n)) AS z0, sum(n * theta1) / sqrt(sum(n * n)) AS z1 FROM sg JOIN th USING (term) GROUP BY {k}"),
        ("scored", f"SELECT p.*, 1 / (1 + exp(p0 + coalesce(z0, 0) - p1 - coalesce(z1, 0))) AS likelihood FROM {passages} p LEFT JOIN sz z ON {on}, pr"),
    ]


_TOXIC = [LAB, *model_ctes("lab", "doc_id", 1, 0.25)]
ORACLE["t06_nb_model"] = ctes(*_TOXIC) + "SELECT term, round(theta0, 6) AS theta0, round(theta1, 6) AS theta1 FROM th"
_QUAL = ("lab", "SELECT doc_id, text, quality AS class FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
ORACLE["t09_train_totals"] = ctes(_QUAL, *model_ctes("lab", "doc_id", 2, 0.5)) + """SELECT round(s0, 4) AS s0, round(s1, 4) AS s1, v, n0, n1,
   round(p0, 6) AS prior0, round(p1, 6) AS prior1 FROM s, pr"""


def shuffled(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5(doc_id || '|42'))"


for _name, _k in (("t10_balanced", 1), ("t10_balanced_1_to_3", 3)):
    ORACLE[_name] = ctes(LAB) + f"""SELECT doc_id, class FROM (SELECT *, {shuffled('lab', 'class')} AS r,
      count(*) FILTER (class = 1) OVER () AS p, count(*) FILTER (class = 0) OVER () AS m FROM lab) WHERE class = 1 OR p >= m OR r <= {_k} * p"""


def masked(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^(19|20)\\p{{Nd}}{{2}}$', 'YEAR'), '\\p{{Nd}}+(\\.\\p{{Nd}}+)?%?', 'NUM', 'g')"


ORACLE["t11_mask_numbers"] = f"SELECT doc_id, {masked('text')} AS text FROM documents"
ORACLE["t11_mask_cells"] = f"""SELECT o_orderkey, {masked('text')} AS masked FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
   THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'up ' || o_custkey || '.5% in ' || year(o_orderdate) END AS text FROM orders)"""


BALANCED_ROWS = f"""SELECT doc_id, text, class, 0 AS fold FROM (SELECT *, {shuffled('x', 'class')} AS r,
   count(*) FILTER (class = 1) OVER () AS p, count(*) FILTER (class = 0) OVER () AS m
   FROM (SELECT doc_id, text, toxic AS class FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL) x) WHERE class = 1 OR p >= m OR r <= p"""


def folds(k: int) -> tuple[str, str]:
    return ("fo", f"SELECT *, CAST(({shuffled('lab', 'class')} - 1) % {k} AS INT) AS fold FROM lab")


def cv_ctes(k: int, high: int, alphas: list[float], tag: str = "") -> list[tuple[str, str]]:
    """Out-of-fold likelihoods: every training set is aggregated on its own."""
    a = ", ".join(f"({x}::DOUBLE)" for x in alphas)
    return [
        ("cw" + tag, f"SELECT doc_id, class, fold, {word_list('text')} AS w FROM fo"),
        ("cg" + tag, grams("cw" + tag, high, "doc_id, class, fold")),
        ("cx" + tag, weights("cg" + tag)),
        ("cf" + tag, f"""SELECT k, term, sum(CASE WHEN class = 0 THEN w ELSE 0 END) AS f0, sum(CASE WHEN class = 1 THEN w ELSE 0 END) AS f1
            FROM cx{tag} JOIN range({k}) r(k) ON fold <> k GROUP BY k, term"""),
        ("cs" + tag, f"SELECT k, sum(f0) AS s0, sum(f1) AS s1, count(*) AS v FROM cf{tag} GROUP BY k"),
        ("cp" + tag, f"""SELECT k, ln(count(*) FILTER (class = 0) / count(*)) AS p0, ln(count(*) FILTER (class = 1) / count(*)) AS p1
            FROM fo JOIN range({k}) r(k) ON fold <> k GROUP BY k"""),
        ("cz" + tag, f"""SELECT doc_id, alpha, sum(n * (ln(f0 + alpha) - ln(s0 + alpha * v))) / sqrt(sum(n * n)) AS z0,
              sum(n * (ln(f1 + alpha) - ln(s1 + alpha * v))) / sqrt(sum(n * n)) AS z1
            FROM cg{tag} g JOIN cf{tag} f ON g.fold = f.k AND g.term = f.term JOIN cs{tag} s ON s.k = f.k, (VALUES {a}) al(alpha)
            GROUP BY doc_id, alpha"""),
        ("cv" + tag, f"""SELECT fo.doc_id, class, fold, al.alpha, 1 / (1 + exp(p0 + coalesce(z0, 0) - p1 - coalesce(z1, 0))) AS likelihood
            FROM fo CROSS JOIN (VALUES {a}) al(alpha) LEFT JOIN cz{tag} z ON z.doc_id = fo.doc_id AND z.alpha = al.alpha JOIN cp{tag} p ON p.k = fo.fold"""),
    ]


ORACLE["t12_folds"] = ctes(LAB, folds(10)) + "SELECT doc_id, class, fold FROM fo"
MASKED = ("lab", f"""SELECT doc_id, {masked('text')} AS text, class FROM (SELECT * FROM ({BALANCED_ROWS}))""")
_CV = [MASKED, folds(10), *cv_ctes(10, 1, [0.25])]
ORACLE["t12_cv_predictions"] = ctes(*_CV) + """SELECT doc_id, class, fold, round(likelihood, 6) AS likelihood,
   CAST(likelihood > 0.5 AS INT) AS prediction FROM cv"""
_CELLS = """count(*) AS n, count(*) FILTER (class = 1 AND likelihood > 0.5) AS tp, count(*) FILTER (class = 0 AND likelihood > 0.5) AS fp,
   count(*) FILTER (class = 1 AND likelihood <= 0.5) AS fn"""
ORACLE["t13_scores"] = ctes(*_CV, ("z", f"SELECT {_CELLS} FROM cv")) + """SELECT n, round((n - fp - fn) / n, 6) AS accuracy,
   round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
   round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM z"""
ORACLE["t14_top_terms"] = ctes(*_TOXIC, ("w", "SELECT term, round(theta1, 6) AS weight FROM th")) + """
   (SELECT weight, term, 'lowest' AS side FROM w ORDER BY weight, term LIMIT 10) UNION ALL
   (SELECT weight, term, 'highest' AS side FROM w ORDER BY weight DESC, term DESC LIMIT 10)"""


# The steepest and the most curved that each loss gets; the hinge is rounded over the last hundredth.
CURVATURE = {"LinearSVC": 2.0, "SGDClassifier": 100.0, "LogisticRegression": 0.25}


def linear_ctes(source: str, settings: list[tuple[str, float]], high: int, folds: list[int | None], tag: str = "", digits: int = 13) -> list[tuple[str, str]]:
    """Models (setting, fold left out) on ``source (doc_id, text, class, fold)`` as minima of mean loss and penalty.

    The weights are a sum over the passages, so the search is for their coefficients, by accelerated descent on the matrix of inner
    products (with a constant term): a method of its own, run until the error has shrunk by ``digits`` powers of ten. Equal passages
    are one row with a number of times.
    """
    t = tag
    values = ", ".join(f"({i * len(folds) + j}, '{c}', {v}::DOUBLE, {'NULL' if f is None else f}::INT, {CURVATURE[c]}::DOUBLE)"
                       for i, (c, v) in enumerate(settings) for j, f in enumerate(folds))
    at = "y[j] * s[j]"
    pull = f"""CASE c WHEN 'LinearSVC' THEN 2 * greatest(0, 1 - {at}) WHEN 'SGDClassifier' THEN greatest(0, least(1, (1 - {at}) * 100))
               ELSE 1 / (1 + exp({at})) END"""
    return [
        ("lw" + t, f"SELECT doc_id, class, fold, {word_list('text')} AS w FROM {source}"),
        ("lg" + t, "/*M*/" + grams("lw" + t, high, "doc_id, class, fold")),
        ("lx" + t, "/*M*/" + weights("lg" + t, "doc_id")),
        ("lp" + t, f"""/*M*/SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM (
            SELECT min(doc_id) AS doc_id, class, fold, count(*)::DOUBLE AS times FROM {source} GROUP BY text, class, fold)"""),
        ("le" + t, f"/*M*/SELECT i, term, w FROM lp{t} JOIN lx{t} USING (doc_id)"),
        ("lk" + t, f"""/*M*/SELECT list(r ORDER BY i) AS kk FROM (
            SELECT a.i, list(1 + coalesce(v, 0) ORDER BY b.i) AS r FROM lp{t} a CROSS JOIN lp{t} b
            LEFT JOIN (SELECT p.i, q.i AS j, sum(p.w * q.w) AS v FROM le{t} p JOIN le{t} q USING (term) GROUP BY p.i, q.i) z ON z.i = a.i AND z.j = b.i GROUP BY a.i)"""),
        ("lm" + t, f"""/*M*/SELECT *, sqrt(pen / top) AS q FROM (SELECT *, pen + curved * (SELECT max(x) FROM (
              SELECT unnest(list_transform(kk, lambda r: list_dot_product(r, times))) AS x FROM lk{t})) / n AS top FROM (
            SELECT m, c, v, f, curved, n, CASE c WHEN 'LinearSVC' THEN 1 / (v * n) WHEN 'SGDClassifier' THEN v ELSE v / n END AS pen, y, times FROM (
              SELECT q.*, sum(CASE WHEN q.f IS NULL OR fold <> q.f THEN times ELSE 0 END) AS n, list(CASE WHEN class = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS y,
                     list(CASE WHEN q.f IS NULL OR fold <> q.f THEN times ELSE 0 END ORDER BY i) AS times
              FROM (VALUES {values}) q(m, c, v, f, curved) CROSS JOIN lp{t} GROUP BY ALL)))"""),
        (f"ld{t}(m, it, b, a) USING KEY (m)", f"""
            SELECT m, 0 AS it, list_transform(y, lambda x: 0::DOUBLE) AS b, list_transform(y, lambda x: 0::DOUBLE) AS a FROM lm{t}
            UNION
            SELECT m, it + 1, now, list_transform(now, lambda x, j: x + (1 - q) / (1 + q) * (x - b[j])) FROM (
              SELECT m, it, q, b, list_transform(a, lambda x, j: x - (pen * x - times[j] * y[j] * ({pull}) / n) / top) AS now FROM (
                SELECT d.m, d.it, d.b, d.a, list_transform(kk, lambda r: list_dot_product(r, d.a)) AS s, lm{t}.* EXCLUDE (m)
                FROM ld{t} d JOIN lm{t} ON lm{t}.m = d.m CROSS JOIN lk{t} WHERE d.it < ceil({digits} * ln(10) / q)))"""),
        ("lc" + t, f"/*M*/SELECT m, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM ld{t}"),
        ("lt" + t, f"/*M*/SELECT m, term, sum(b * w) AS theta FROM lc{t} JOIN le{t} USING (i) GROUP BY m, term"),
        ("lb" + t, f"/*M*/SELECT m, sum(b) AS bias FROM lc{t} GROUP BY m"),
        ("ls" + t, f"""SELECT m, c, v, doc_id, class, p.fold, bias + coalesce(z, 0) AS score
        FROM (SELECT DISTINCT doc_id, class, fold FROM lw{t}) p CROSS JOIN lm{t} JOIN lb{t} USING (m)
        LEFT JOIN (SELECT m, doc_id, sum(g.n * theta) / sqrt(sum(g.n * g.n)) AS z FROM lg{t} g JOIN lt{t} USING (term) JOIN lm{t} USING (m)
                   WHERE f IS NULL OR (fold = f AND term IN (SELECT term FROM lg{t} o WHERE o.fold <> g.fold)) GROUP BY m, doc_id) USING (m, doc_id)
        WHERE f IS NULL OR f = p.fold"""),
    ]


def linear_scores(source: str, tag: str, high: int = 1) -> list[tuple[str, str]]:
    """``ps``: scores of ``source (doc_id, text)`` by the one model of the tag."""
    t = tag
    return [("pw" + t, f"SELECT doc_id, {word_list('text')} AS w FROM {source}"), ("pg" + t, grams("pw" + t, high, "doc_id")),
            ("ps" + t, f"""SELECT doc_id, bias + coalesce(z, 0) AS score FROM (SELECT doc_id FROM {source}) CROSS JOIN lb{t}
              LEFT JOIN (SELECT doc_id, sum(g.n * theta) / sqrt(sum(g.n * g.n)) AS z FROM pg{t} g JOIN lt{t} USING (term) GROUP BY doc_id) USING (doc_id)""")]


BALANCED = ("lab", BALANCED_ROWS)
_DECIDED = "CAST(round(score, 9) > 0 AS INT) AS prediction"
for _name, _c, _v in (("t07_linear_svc", "LinearSVC", 1.0), ("t08_sgd_hinge", "SGDClassifier", 1e-3)):
    ORACLE[_name] = ctes(BALANCED, *linear_ctes("lab", [(_c, _v)], 1, [None])) + f"SELECT doc_id, class, round(score, 4) AS score, {_DECIDED} FROM ls"
ORACLE["h01_category_model"] = ctes(BALANCED, *linear_ctes("lab", [("LogisticRegression", 1.0)], 1, [None])) + f"""
   SELECT doc_id, class, round(1 / (1 + exp(-score)), 4) AS probability, {_DECIDED} FROM ls"""

_F1 = """SELECT {keys}, round(avg(f1), 6) AS f1 FROM (
   SELECT {keys}, fold, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
   FROM (SELECT {keys}, fold, count(*) FILTER (class = 1 AND hit) AS tp, count(*) FILTER (class = 0 AND hit) AS fp,
                count(*) FILTER (class = 1 AND NOT hit) AS fn FROM {source} GROUP BY {keys}, fold)) GROUP BY {keys}"""
_GRID = [("lab", f"SELECT doc_id, text, class FROM ({BALANCED_ROWS})"), folds(5)]
_GRID_PARTS = []
for _h in NGRAM_HIGHS:
    _GRID += cv_ctes(5, _h, NB_ALPHA, f"_{_h}")
    _GRID_PARTS.append(f"SELECT 'MultinomialNB' AS classifier, CAST({_h} AS INT) AS ngram_high, alpha AS value, f1 FROM ("
                       + _F1.format(keys="alpha", source=f"(SELECT *, likelihood > 0.5 AS hit FROM cv_{_h})") + ")")
    _settings = [("LinearSVC", c) for c in SVC_C] + [("SGDClassifier", a) for a in SGD_ALPHA]
    _GRID += linear_ctes("fo", _settings, _h, list(range(5)), f"_{_h}x", digits=8)
    _GRID_PARTS.append(f"SELECT c AS classifier, CAST({_h} AS INT) AS ngram_high, v AS value, f1 FROM ("
                       + _F1.format(keys="c, v", source=f"(SELECT *, round(score, 9) > 0 AS hit FROM ls_{_h}x)") + ")")
ORACLE["t15_grid_search"] = ctes(*_GRID) + " UNION ALL ".join(_GRID_PARTS)
_SCORE = [*_TOXIC, ("docs", "SELECT doc_id, text FROM documents"), *score_ctes("docs", ["doc_id"], 1)]
ORACLE["t16_batch_scores"] = ctes(*_SCORE) + "SELECT doc_id, round(likelihood, 6) AS likelihood, CAST(likelihood > 0.5 AS INT) AS predicted_class FROM scored"
ORACLE["s06_saved_model"] = ORACLE["t16_batch_scores"]
ORACLE["s06_saved_linear_model"] = ORACLE["t07_linear_svc"]
ORACLE["h02_split"] = f"""SELECT doc_id, {shuffled('documents')} <= floor(count(*) OVER () * 0.8::DOUBLE) AS is_train FROM documents"""
ORACLE["h03_encode_labels"] = ctes(LAB) + "SELECT doc_id, class = 1 AS healthcare, class <> 1 AS no_healthcare FROM lab"
_CATEGORY = [BALANCED, ("tr", f"SELECT * EXCLUDE (r, k) FROM (SELECT *, {shuffled('lab')} AS r, count(*) OVER () AS k FROM lab) WHERE r <= floor(k * 0.8::DOUBLE)"),
             ("rest", "SELECT doc_id, text, toxic AS class FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM tr)"),
             *linear_ctes("tr", [("LogisticRegression", 0.01)], 1, [None]), *linear_scores("rest", ""),
             ("pb", "SELECT doc_id, class, 1 / (1 + exp(-score)) AS p FROM ps JOIN rest USING (doc_id)")]
_PAIRS = ("pairs", "SELECT p AS score, class = 1 AS gold FROM pb UNION ALL SELECT 1 - p, class <> 1 FROM pb")
ORACLE["h04_category_scores"] = ctes(*_CATEGORY, _PAIRS, ("z", """SELECT count(*) FILTER (score >= 0.5 AND gold) + 1e-8 AS tp,
   count(*) FILTER (score >= 0.5 AND NOT gold) + 1e-8 AS fp, count(*) FILTER (score < 0.5 AND gold) + 1e-8 AS fn FROM pairs"""),
  ("y", "SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM z")) + """SELECT round(p, 6) AS textcat_p, round(r, 6) AS textcat_r,
   round(2 * p * r / (p + r), 6) AS textcat_f FROM y"""
ORACLE["h05_decide"] = ctes(*_CATEGORY) + "SELECT doc_id, CAST(p >= 0.7 AS INT) AS decision FROM pb"
ORACLE["h06_rounded_probability"] = ctes(*_CATEGORY) + "SELECT doc_id, round_even(p, 3) AS probability FROM pb"

# --- results -----------------------------------------------------------------------------
_CARE = [*CLEANED, *TOKENS, *match_ctes("parental_care"),
         ("fl", "SELECT *, CAST((page + paragraph) % 3 = 0 AS INT) AS flag FROM mt")]


def collected(per_part: int | None = None, source: str = "fl") -> tuple[str, str]:
    part = f", CAST((k - 1) // {per_part} AS INT) AS part" if per_part else ""
    return ("col", f"""SELECT filename, name, year, 1 AS class{part},
        string_agg(page, ',' ORDER BY k) AS predicted_page, string_agg(text, chr(10) ORDER BY k) AS predicted_text
      FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY page, paragraph) AS k FROM {source} WHERE flag = 1)
      GROUP BY ALL""")


ALL_REPORTS = """SELECT r.filename, replace(split_part(r.filename, '_Annual_Report_', 1), '_', ' ') AS name,
   split_part(split_part(r.filename, '_Annual_Report_', 2), '.', 1) AS year, coalesce(class, 0) AS class,
   coalesce(predicted_page, '') AS predicted_page, coalesce(predicted_text, '') AS predicted_text
   FROM (SELECT DISTINCT filename FROM b) r LEFT JOIN col ON r.filename = col.filename"""
ORACLE["a02_report_class"] = ctes(*_CARE) + "SELECT filename, name, year, max(flag) AS class FROM fl GROUP BY ALL"
ORACLE["a03_positive_passages"] = ctes(*_CARE) + "SELECT filename, paragraph, page AS predicted_page, text AS predicted_text FROM fl WHERE flag = 1"
ORACLE["a04_collect_passages"] = ctes(*_CARE, collected()) + "SELECT * FROM col"
ORACLE["a04_collect_in_parts"] = ctes(*_CARE, collected(2)) + "SELECT * FROM col"
ORACLE["a05_not_found_rows"] = ctes(*_CARE, collected()) + ALL_REPORTS
_LTIFR = [*CLEANED, *TOKENS, *match_ctes("ltifr"), ("fl0", frequent("mt")),
          ("fl", "SELECT *, predicted_text_class AS flag FROM fl0"), collected()]
ORACLE["a06_assess_ltifr"] = ctes(*_LTIFR) + ALL_REPORTS
ORACLE["a07_assess_report"] = ORACLE["a06_assess_ltifr"] + " WHERE r.filename = (SELECT min(filename) FROM mt)"
_EMP = [*CLEANED, *TOKENS, *match_ctes("n_employees"),
        ("lab", "SELECT *, CAST(contains(text, 'number of employees') AND page % 5 <> 0 AS INT) AS class FROM mt"),
        *model_ctes("lab", "filename, page, paragraph", 3, 0.25), *score_ctes("mt", ["filename", "page", "paragraph"], 3),
        ("win", best("scored")),
        ("fl", """SELECT z.*, CAST(win.page IS NOT NULL AND z.likelihood > 0.6 AS INT) AS flag
           FROM scored z LEFT JOIN win ON z.filename = win.filename AND z.page = win.page"""), collected()]
ORACLE["a01_scored_passages"] = ctes(*_EMP) + "SELECT filename, page, paragraph, round(likelihood, 6) AS likelihood, flag AS predicted_text_class FROM fl"
ORACLE["a06_assess_n_employees"] = ctes(*_EMP) + ALL_REPORTS


def matched(metric: str) -> list[tuple[str, str]]:
    """Matches of a metric on its pages, as far as assessing needs them."""
    return [*match_ctes(metric, f"n_{metric}"), (f"m_{metric}", f"SELECT filename, page, paragraph, text FROM n_{metric}")]


def passages_of(metrics: list[str]) -> list[tuple[str, str]]:
    parts = [c for m in metrics for c in matched(m)]
    union = " UNION ALL ".join(f"SELECT {q(m)} AS metric, * FROM m_{m}" for m in metrics)
    return [*parts, ("mt", f"""/*M*/SELECT *, metric || '|' || filename || '|' || page || '|' || paragraph AS doc_id,
      replace(split_part(filename, '_Annual_Report_', 1), '_', ' ') AS name, split_part(split_part(filename, '_Annual_Report_', 2), '.', 1) AS year,
      CAST((page + paragraph) % 3 <> 0 AS INT) AS class, 0 AS fold FROM ({union})""")]


def flagged(metrics: list[str]) -> list[tuple[str, str]]:
    """``fl``: passages with ``flag`` by the scorer of their metric; one Bayes model of all marked matches, one category model of healthcare."""
    flags, out = [], []
    bayes = [m for m in metrics if METRICS[m].scorer in ("predict", "best_page")]
    if bayes:
        out += [*model_ctes("mt", "doc_id", 1, 0.25), *score_ctes("mt", ["doc_id"], 1)]
        flags.append(f"SELECT *, likelihood > 0.5 AS flag FROM scored WHERE metric IN {qlist(m for m in bayes if METRICS[m].scorer == 'predict') if any(METRICS[m].scorer == 'predict' for m in bayes) else '(NULL)'}")
        for m in bayes:
            if METRICS[m].scorer == "best_page":
                out += [(f"s_{m}", f"SELECT * FROM scored WHERE metric = {q(m)}"), (f"w_{m}", best(f"s_{m}"))]
                flags.append(f"SELECT z.*, w.page IS NOT NULL AND z.likelihood > 0.6 AS flag FROM s_{m} z LEFT JOIN w_{m} w ON z.filename = w.filename AND z.page = w.page")
    for m in metrics:
        if METRICS[m].scorer == "frequent_page":
            flags.append(f"SELECT * EXCLUDE (n, predicted_text_class), NULL::DOUBLE AS likelihood, predicted_text_class = 1 AS flag FROM ({frequent(f'(SELECT * FROM mt WHERE metric = {q(m)})')})")
        if METRICS[m].scorer == "category":
            out += [("hc", "SELECT * FROM mt WHERE metric = 'healthcare'"),
                    ("ht", "SELECT doc_id, text, CAST(NOT regexp_matches(text, 'for [0-2] ') AS INT) AS class, 0 AS fold FROM hc WHERE page % 2 = 0"),
                    *linear_ctes("ht", [("LogisticRegression", 0.01)], 1, [None], "h"), *linear_scores("hc", "h")]
            flags.append("SELECT hc.*, NULL::DOUBLE AS likelihood, 1 / (1 + exp(-score)) >= 0.7 AS flag FROM hc JOIN psh USING (doc_id)")
    union = " UNION ALL ".join(f"SELECT metric, filename, name, year, page, paragraph, text, CAST(flag AS INT) AS flag FROM ({f})" for f in flags)
    return [*out, ("fl", union)]


def assessed(metrics: list[str]) -> list[tuple[str, str]]:
    return [*CLEANED, *TOKENS, *passages_of(metrics), *flagged(metrics),
            ("col", """SELECT metric, filename, 1 AS class, string_agg(page, ',' ORDER BY page, paragraph) AS predicted_page,
                string_agg(text, chr(10) ORDER BY page, paragraph) AS predicted_text FROM fl WHERE flag = 1 GROUP BY metric, filename""")]


for _m in ASSESSED:
    ORACLE[f"a06_assess_{_m}"] = ctes(*assessed([_m])) + ALL_REPORTS
ORACLE["a06_assess_all"] = ctes(*assessed(list(METRICS))) + """SELECT r.filename, replace(split_part(r.filename, '_Annual_Report_', 1), '_', ' ') AS name,
   split_part(split_part(r.filename, '_Annual_Report_', 2), '.', 1) AS year, r.metric, coalesce(class, 0) AS class,
   coalesce(predicted_page, '') AS predicted_page, coalesce(predicted_text, '') AS predicted_text
   FROM (SELECT DISTINCT filename, metric FROM b CROSS JOIN (SELECT unnest([""" + ", ".join(q(m) for m in METRICS) + """]) AS metric)) r
   LEFT JOIN col ON r.filename = col.filename AND r.metric = col.metric"""
_FIRST = ("b", f"SELECT * FROM ({report_blocks_sql()}) WHERE filename IN (SELECT DISTINCT filename FROM ({report_blocks_sql()}) ORDER BY filename LIMIT 80)")
ORACLE["a08_training_candidates"] = ctes(_FIRST, *CLEANED[1:], *TOKENS, *match_ctes("n_employees")) + "SELECT * FROM mt"
