"""Personal data by candidate gradient boosting.

Rules find the plain kinds (email, ip, card, phone). Beyond them several
generators propose spans, which may overlap: disguised addresses, long tokens,
tokens after a word such as password, numbers of any grouping and the runs of
digit groups inside them. Boosted trees judge a candidate by its format and by
what stands around it, and thresholds calibrated on the held-out candidates of
all texts select what is added, the best first where they overlap.

The trees are fitted on weak labels. A candidate is positive if a rule finds
it, if it follows a word such as password or token, or if it begins like an
access key. What no rule can find has its positives from rewriting: each
address and phone of the rules is written out again between its neighbours,
disguised (``[at]``, ``dot``) or without its plus. What looks like a
disguised address, or like a phone after a word such as call, and is vouched
for by nothing has no label. Half of the rows hide the plus sign, the
beginning and the context, so that format alone must do as well.

Everything runs as column expressions in the row of the text: spans are
found, judged and sorted without a shuffle, and the trees become one CASE
expression. The judged rows are written once; one grouped count of their
scores gives the thresholds. Patterns use possessive loops, which Java runs without recursion,
and start where a run of characters starts, so long texts take linear time.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import let, staged

KINDS = ["email", "ip", "card", "phone", "secret"]
LOCAL = "A-Za-z0-9._%+-"
#: The rules, each as the leftmost non-overlapping matches of its pattern.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: The generators: disguised addresses, tokens of 16 characters or more, tokens of any length after a cue (which ends within
#: 5 signs before), numbers of two digits or more.
AT = r"[\[({ ]at[\])} ]"
DISGUISED = (
    rf"(?<![{LOCAL}])[{LOCAL}]++(?: ?[\[({{]at[\])}}] ?| at )[A-Za-z0-9-]++"
    r"(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]++)++")
BRACKETED, SPELLED = r"[\[({]at[\])}]", r"[\[({ ]dot[\])} ]"
#: How an address is disguised: what stands for the at and for a dot.
DISGUISES = [(" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", "."), ("(at)", "."), ("[at]", "[dot]"), (" {at} ", " {dot} ")]
#: How a phone is written without its plus: as it is, or its country code dropped or become a zero.
BARE = [(r"^\+", ""), (r"^\+[0-9]{1,3}[ .-]+(?=[0-9(])", ""), (r"^\+[0-9]{1,3}[ .-]+\(?([0-9]+)\)?", "0$1")]
#: Trees tell apart no fewer rows than this, so that single wrong labels are not learned.
LEAST_ROWS = 10
LONG = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+=*+"
SECRET_WORDS = "(?:password|passwd|pwd|secret|token|api.?key|access.?key)"
CUED = (rf"(?<![^\s\"'=:(\[{{,;])(?=[^\s\"'<>,;()\[\]{{}}=:])(?<=(?i:{SECRET_WORDS})\W{{0,5}})"
        r"[^\s\"'<>,;()\[\]{}]*[^\s\"'<>,;()\[\]{}.:!?]")
NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,2}+[0-9])++"
#: Digits of the parts of a number that are proposed on their own: from short phones to long cards.
PART_DIGITS = 7, 19
SECRET_CUE = rf"(?i){SECRET_WORDS}\W{{0,5}}$"
#: Beginnings of access keys of public services.
KEY_PREFIX = "^(?:AKIA|ASIA|ghp_|xoxb-|xoxp-|sk-|eyJ)"
CUES = {
    "cue_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\w*(?:\W{1,2}\w{1,6}){0,2}\W{0,5}$",
    "cue_mail": r"(?i)(?:mail|contact|write)\w*(?:\W{1,2}\w{1,6}){0,2}\W{0,5}$",
    "cue_card": r"(?i)(?:card|visa|account|iban)\w*\W{0,5}$",
    "cue_number": r"(?i)(?:version|license|chapter|page|section|isbn|by-nc|no|nr)\W{0,5}$",
}
BLOCK = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"


def running_sums(sizes: Column) -> Column:
    """Running sums of an int array, block by block, so that long arrays are not copied for every element."""

    def block(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
        return F.aggregate(values, start, step, lambda a: a["all"])

    def shifted(blocks: Column) -> Column:
        totals = block(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(totals, lambda t: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))))

    starts = F.sequence(F.lit(0), ((F.size(sizes) - 1) / BLOCK).cast("int"))
    return let(F.transform(starts, lambda b: block(F.slice(sizes, b * BLOCK + 1, BLOCK))), shifted)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: ``start, end`` in code points, ``m``, and the text between it and its neighbours, cut to 24."""
    one = "struct<start:int,end:int,m:string,before:string,after:string>"

    def placed(found: Column) -> Column:
        def measured(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
            return let(running_sums(steps), lambda ends: F.transform(ends, lambda e, i: F.struct(
                (e - F.length(F.get(found, i))).alias("start"), e.alias("end"), F.get(found, i).alias("m"),
                F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.substring(F.get(gaps, i + 1), 1, 24).alias("after"))))

        return let(F.split(text, pattern, -1), measured)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(f"array<{one}>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _span(kind: str, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"))


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans that the rules find: ``start, kind`` (as its place in KINDS), ``end``."""
    passing = {
        "email": (EMAIL, F.instr(text, "@") > 0, lambda m: F.lit(True)),
        "ip": (IP, text.rlike("[0-9]"), lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": (CARD, text.rlike("[0-9]"),
                 lambda m: F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))),
        "phone": (PHONE, F.instr(text, "+") > 0, lambda m: F.length(digits(m)).between(9, 15)),
    }
    def spans(kind: str) -> Column:
        pattern, some, good = passing[kind]
        passed = F.filter(matches(text, pattern), lambda m: good(m["m"]))
        return F.when(some, F.transform(passed, lambda m: _span(kind, m))).otherwise(F.array().cast(SPANS))

    return {kind: spans(kind) for kind in passing}


def longest_group(text: Column) -> Column:
    """Length of the longest run of digits."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9]++"), F.lit(0)), F.length)), F.lit(0))


def features(m: Column) -> dict[str, Column]:
    """Numbers that describe a candidate by format and context."""
    text, count = m["m"], lambda p: F.length(F.regexp_replace(m["m"], p, ""))
    flag = lambda c: c.cast("int")
    return {
        "length": F.length(text), "digits": count("[^0-9]"), "upper": count("[^A-Z]"), "lower": count("[^a-z]"),
        "separators": count("[A-Za-z0-9]"), "groups": F.size(F.split(text, "[^0-9]++", -1)),
        "changes": F.size(F.split(text, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)),
        "hex": flag(text.rlike("^[0-9a-f]+$")), "at": flag(text.rlike(AT)),
        "bracketed": flag(text.rlike(BRACKETED)), "spelled": flag(text.rlike(SPELLED)), "name_end": flag(text.rlike("[A-Za-z]{2,}$")),
        "zero": flag(text.startswith("0")), "longest": longest_group(text),
        "luhn": flag(F.coalesce(F.call_function("luhn_check", digits(text)), F.lit(False))),
        "plus": flag(text.startswith("+")), "quoted": flag(m["before"].rlike("[\"'=:]$")),
        "assigned": flag(m["before"].rlike(r"[=:]\s*[\"']?$")),
        "prefix": flag(text.rlike(KEY_PREFIX)), "cue_secret": flag(m["before"].rlike(SECRET_CUE)), **{n: flag(m["before"].rlike(p)) for n, p in CUES.items()},
    }


#: What half of the training rows hide.
CONTEXT = ["plus", "prefix", "quoted", "assigned", "cue_secret", *CUES]


def kind_of(f: Column) -> Column:
    """The kind that a candidate would be, as its place in KINDS."""
    return (F.when(f["at"] == 1, 0).when(f["upper"] + f["lower"] > 0, 4)
            .when((f["digits"] >= 12) & (f["plus"] == 0), 2).otherwise(3))


def number_parts(m: Column) -> Column:
    """The runs of digit groups inside a number that may be a phone or card of their own; each looks at a bounded number of groups."""
    least, most = PART_DIGITS

    def runs(groups: Column) -> Column:
        last = F.size(groups) - 1

        def joined(start: Column, size: Column) -> Column:
            return F.array_join(F.transform(F.slice(groups, start + 1, size), lambda g: F.concat(g["m"], g["after"])), "")

        def from_group(i: Column) -> Column:
            near = F.least(i, F.lit(24))
            before = F.right(F.concat(m["before"], joined(i - near, near)), F.lit(24))
            upto = F.sequence(i, F.least(i + (most - 1), last))
            return let(before, lambda around: F.filter(F.transform(upto, lambda j: F.struct(
                (m["start"] + F.get(groups, i)["start"]).alias("start"), (m["start"] + F.get(groups, j)["end"]).alias("end"),
                F.concat(joined(i, j - i), F.get(groups, j)["m"]).alias("m"), around.alias("before"))),
                lambda w: F.length(digits(w["m"])).between(least, most) & ((w["start"] > m["start"]) | (w["end"] < m["end"]))))

        return F.flatten(F.transform(F.sequence(F.lit(0), last), from_group))

    one = "struct<start:int,end:int,m:string,before:string>"
    return F.when(m["m"].rlike("[^0-9]") & (F.length(digits(m["m"])) > least),
                  let(matches(m["m"], "[+(]?[0-9]++"), runs)).otherwise(F.array().cast(f"array<{one}>"))


def candidates(text: Column) -> Column:
    """Candidates of all generators, which may overlap, with their features ``f``; ``part`` if inside a longer number."""
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    mails = F.when(text.rlike(AT), F.filter(matches(text, DISGUISED), lambda m: m["m"].rlike(AT))).otherwise(none)
    long = F.filter(matches(text, LONG), lambda m: m["m"].rlike("[0-9]"))
    # A word without digits is one only if it is assigned: "the secret of" is not.
    cued = F.when(text.rlike(f"(?i){SECRET_WORDS}"), F.filter(
        matches(text, CUED), lambda m: m["m"].rlike("[0-9]") | m["before"].rlike(r"[=:]\s*[\"']?$"))).otherwise(none)

    def described(found: Column, part: bool) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(part).alias("part"),
            F.struct(*[c.alias(n) for n, c in features(m).items()]).alias("f")))

    # Lone digits that begin a token of letters and digits are no number.
    worth = lambda m: ~m["m"].rlike("^[0-9]+$") | ~m["after"].rlike("^[A-Za-z]")
    numbers = let(F.filter(matches(text, NUMBER), worth), lambda found: F.concat(
        described(found, False), described(F.flatten(F.transform(found, number_parts)), True)))
    return F.concat(described(F.concat(mails, long, cued), False), F.when(text.rlike("[0-9]"), numbers).otherwise(described(none, False)))


def overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))


def is_span(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"]))


def weak_label(c: Column, base: Column) -> Column:
    """1 for what a rule, a cue or the beginning vouches for; null for what overlaps a span of the rules by a part or may be a disguise."""
    f, touches = c["f"], overlaps(c, base)
    after_cue = (f["cue_secret"] == 1) & ((f["digits"] > 1) | (f["assigned"] == 1) | (f["upper"] + f["lower"] > 0))
    vouched = after_cue | (f["prefix"] == 1)
    disguise = (f["at"] == 1) & ((f["bracketed"] == 1) | (f["spelled"] == 1) | (f["cue_mail"] == 1))
    number = (f["upper"] + f["lower"] == 0) & (f["cue_phone"] == 1) & f["digits"].between(7, 15)
    whole = F.when(touches & (f["at"] == 1), F.lit(None)).when(touches | vouched, 1.0).when(~disguise & ~number, 0.0)
    return F.when(c["part"], F.when(is_span(c, base), 1.0).when(~touches & ~number, 0.0)).otherwise(whole)


def rewritten(text: Column) -> Column:
    """Addresses and phones of the rules between their neighbours, disguised: ``around``, and ``plain`` as the rules found it."""
    none = F.array().cast("array<struct<around:string,plain:string>>")

    def written_as(m: Column, plain: Column, at: Column, dot: Column) -> Column:
        address = F.concat(F.substring_index(plain, "@", 1), at, F.replace(F.substring_index(plain, "@", -1), F.lit("."), dot))
        return F.struct(F.concat(m["before"], address, m["after"]).alias("around"), plain.alias("plain"))

    def mail(m: Column) -> Column:
        way = F.xxhash64(m["m"])
        at, dot = (F.element_at(F.array(*[F.lit(d[i]) for d in DISGUISES]), (F.pmod(way, F.lit(len(DISGUISES))) + 1).cast("int")) for i in (0, 1))
        # Every second one without its digits, which are no mark of an address.
        return written_as(m, F.when(F.shiftright(way, 20) % 2 == 0, F.regexp_replace(m["m"], "[0-9]", "")).otherwise(m["m"]), at, dot)

    def phone(m: Column) -> Column:
        way = F.pmod(F.xxhash64(m["m"]), F.lit(len(BARE)))
        bare = F.coalesce(*[F.when(way == i, F.regexp_replace(m["m"], *how)) for i, how in enumerate(BARE)])
        bare = F.when(F.length(digits(bare)) >= 7, bare).otherwise(F.regexp_replace(m["m"], *BARE[0]))
        return F.struct(F.concat(m["before"], bare, m["after"]).alias("around"), digits(bare).alias("plain"))

    mails = F.when(F.instr(text, "@") > 0, F.transform(matches(text, EMAIL), mail)).otherwise(none)
    phones = F.when(F.instr(text, "+") > 0, F.transform(
        F.filter(matches(text, PHONE), lambda m: F.length(digits(m["m"])).between(9, 15)), phone)).otherwise(none)
    return F.concat(mails, phones)


def disguised(text: Column) -> Column:
    """Features ``f`` and hash ``h`` of the candidates that are the rewritten addresses and phones of a text."""

    def found(r: Column) -> Column:
        def told(m: Column) -> Column:
            back = F.regexp_replace(F.regexp_replace(m, r" ?[\[({]at[\])}] ?| at ", "@"), r" ?[\[({]dot[\])}] ?| dot ", ".")
            return F.when(F.instr(r["plain"], "@") > 0, back == r["plain"]).otherwise(~m.rlike("[A-Za-z]") & (digits(m) == r["plain"]))

        return F.transform(F.filter(candidates(r["around"]), lambda c: told(F.substring(r["around"], c["start"] + 1, c["end"] - c["start"]))),
                           lambda c: F.struct(c["f"].alias("f"), F.xxhash64(r["plain"], c["f"]).alias("h")))

    return F.flatten(F.transform(rewritten(text), found))

def best_apart(spans: Column) -> Column:
    """Of ``start, kind, end, score``: from the best score down, each that overlaps none taken before."""
    one = "struct<start:int,kind:int,end:int,score:double>"
    state = lambda done, open_, upto: F.struct(done.alias("done"), open_.alias("open"), upto.alias("upto"))
    none = F.array().cast(f"array<{one}>")

    def step(a: Column, s: Column) -> Column:  # gathers groups of spans that hang together
        apart = s["start"] >= a["upto"]
        return state(F.when(apart, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]),
                     F.when(apart, F.array(s)).otherwise(F.concat(a["open"], F.array(s))), F.greatest(a["upto"], s["end"]))

    groups = F.aggregate(F.array_sort(spans), state(F.array().cast(f"array<array<{one}>>"), none, F.lit(0)), step,
                         lambda a: F.concat(a["done"], F.array(a["open"])))

    def apart(group: Column) -> Column:
        ranked = F.array_sort(F.transform(group, lambda s: F.struct(
            (-s["score"]).alias("rank"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.aggregate(ranked, F.array().cast(SPANS), lambda kept, s: F.when(overlaps(s, kept), kept).otherwise(
            F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))))

    return F.flatten(F.transform(groups, apart))


class SpanModel:
    """Boosted trees as an expression, and the least score that is added for each kind."""

    def __init__(self, trees: list[tuple[float, list[str]]], names: list[str], thresholds: dict[int, float]):
        self.trees, self.names, self.thresholds = trees, names, thresholds

    def margin(self, f: Column) -> Column:
        """Half the log-odds that a candidate is personal data."""

        def walk(lines: list[str]) -> Column:
            line = lines.pop(0).strip()
            if line.startswith("Predict:"):
                return F.lit(float(line.split(":")[1]))
            number, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
            low = walk(lines)
            lines.pop(0)
            return F.when(f[self.names[int(number)]] <= float(bound), low).otherwise(walk(lines))

        return sum((F.lit(weight) * walk(list(lines)) for weight, lines in self.trees), F.lit(0.0))

    @staticmethod
    def fit(docs: DataFrame, rows: int = 5_000, precision: float = 0.98, trees: int = 10, depth: int = 4) -> SpanModel:
        """Trees from a sample of about ``rows`` texts, thresholds from the candidates of all texts."""
        model = SpanModel.fit_trees(docs, rows, trees, depth)
        model.calibrate(staged(_judged(docs, model).select("scored", "vouched"), "pii-judged"), precision)
        return model

    @staticmethod
    def fit_trees(docs: DataFrame, rows: int = 5_000, trees: int = 10, depth: int = 4) -> SpanModel:
        """Trees fitted on the candidates of a hash sample of about ``rows`` texts, without thresholds; a third of them is left for those."""
        share = min(1.0, rows / max(1, docs.count()))
        drawn = F.pmod(F.xxhash64("text", *[c for c in ("doc_id",) if c in docs.columns], F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))
        # Written first: the optimiser would otherwise look for candidates before the draw.
        text = staged(docs.filter(drawn & F.col("text").isNotNull()).select("text"), "pii-sample")
        found = text.select(candidates(F.col("text")).alias("c"), F.concat(*base_spans(F.col("text")).values()).alias("base"),
                            disguised(F.col("text")).alias("r"))
        plain = found.select(F.explode("c").alias("c"), "base").select(
            F.col("c.f").alias("f"), hash_of(F.col("c")).alias("h"), weak_label(F.col("c"), F.col("base")).alias("label"))
        told = found.select(F.explode("r").alias("r")).select("r.f", "r.h", F.lit(1.0).alias("label"))
        each = plain.filter("label IS NOT NULL").unionByName(told)
        names = each.select("f.*").columns
        hidden = F.pmod("h", F.lit(2)) == 0
        fitting = staged(each.filter(for_fitting(F.col("h"))).select("label", *[
            (F.when(hidden, 0).otherwise(F.col(f"f.{c}")) if c in CONTEXT else F.col(f"f.{c}")).cast("double").alias(c) for c in names]), "pii-fit")
        if fitting.select("label").distinct().count() < 2:  # nothing to tell apart: only the rules speak
            return SpanModel([], names, {})
        fitted = GBTClassifier(maxIter=trees, maxDepth=depth, minInstancesPerNode=LEAST_ROWS, seed=7, featuresCol="x").fit(
            VectorAssembler(inputCols=names, outputCol="x").transform(fitting))
        parts = re.split(r"Tree \d+ \(weight ([0-9.Ee+-]+)\):\n", fitted.toDebugString)[1:]
        return SpanModel([(float(w), t.rstrip().split("\n")) for w, t in zip(parts[::2], parts[1::2])], names, {})

    def blind_margin(self, f: Column, h: Column) -> Column:
        """The margin, without the context for every second candidate, as in fitting."""
        masked = F.struct(*[(F.when(F.pmod(h, F.lit(2)) == 0, 0).otherwise(f[c]) if c in CONTEXT else f[c]).alias(c) for c in self.names])
        return let(masked, self.margin)

    def calibrate(self, judged: DataFrame, precision: float = 0.98) -> None:
        """Per kind the least score above which ``precision`` of the labelled candidates of all texts are personal data.

        One grouped count by kind and hundredth of the score, so what the driver sees does not grow with the table.
        """
        if not self.trees:
            return
        seen = judged.select(F.explode(F.concat(
            F.transform("scored", lambda c: F.struct(c["kind"].alias("kind"), c["blind"].alias("blind"), c["label"].alias("label"))), "vouched")).alias("c")).select("c.*").filter("label IS NOT NULL")
        table = seen.groupBy("kind", (F.floor(F.col("blind") * 100) / 100).alias("score")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).orderBy(F.desc("score")).collect()
        for kind in {r["kind"] for r in table}:
            n = good = 0
            seen_scores = [r for r in table if r["kind"] == kind]
            for r, below in zip(seen_scores, [*(x["score"] for x in seen_scores[1:]), -float("inf")]):
                # From the best score down, as long as what is above is precise enough; the bound lies halfway to the next score, not under even odds.
                n, good = n + r["n"], good + r["good"]
                if good >= precision * n and r["score"] > 0:
                    self.thresholds[kind] = max(0.0, (r["score"] + below) / 2)

    def scored(self, text: Column, base: Column) -> Column:
        """All candidates with their scores; ``label`` only for those held out from fitting."""
        one = "array<struct<start:int,kind:int,end:int,score:double,blind:double,label:double>>"
        if not self.trees:
            return F.array().cast(one)
        return F.transform(candidates(text), lambda c: let(hash_of(c), lambda h: F.struct(
            c["start"].alias("start"), kind_of(c["f"]).alias("kind"), c["end"].alias("end"), self.margin(c["f"]).alias("score"),
            self.blind_margin(c["f"], h).alias("blind"), F.when(~for_fitting(h), weak_label(c, base)).alias("label")))).cast(one)

    def vouched(self, text: Column) -> Column:
        """The held-out rewritten addresses and phones, in the same form as labelled candidates."""
        one = "array<struct<kind:int,blind:double,label:double>>"
        if not self.trees:
            return F.array().cast(one)
        return F.transform(disguised(text), lambda r: F.struct(
            kind_of(r["f"]).alias("kind"), self.blind_margin(r["f"], r["h"]).alias("blind"), F.when(~for_fitting(r["h"]), 1.0).alias("label"))).cast(one)

    def chosen(self, scored: Column, base: Column) -> Column:
        """Of the candidates that reach the threshold of their kind and touch no span of the rules, the best ones that do not overlap."""
        if not self.thresholds:
            return F.array().cast(SPANS)
        least = F.create_map(*[F.lit(x) for kind, score in self.thresholds.items() for x in (kind, score)])
        good = F.filter(scored, lambda c: (c["score"] >= F.coalesce(F.try_element_at(least, c["kind"]), F.lit(float("inf"))))
                        & ~overlaps(c, base))
        return best_apart(F.transform(good, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "kind", "end", "score")])))


def hash_of(c: Column) -> Column:
    """Decides whether a candidate fits the trees and whether its context is hidden."""
    return F.xxhash64(c["start"], c["end"], c["f"])


def for_fitting(h: Column) -> Column:
    """Two of three candidates fit the trees, the third sets thresholds."""
    return F.pmod(h, F.lit(3)) > 0


def _judged(docs: DataFrame, model: SpanModel) -> DataFrame:
    """``row`` (all columns of ``docs``), ``found`` (spans of the rules by kind), ``base``, ``scored`` and ``vouched``."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # A generator keeps the optimiser from computing the spans once per use.
    found = F.explode(F.array(F.struct(*[c.alias(k) for k, c in base_spans(F.col("text")).items()])))
    rows = rows.select("row", "text", found.alias("found")).withColumn("base", F.concat(*[F.col(f"found.{k}") for k in KINDS[:4]]))
    both = F.struct(model.scored(F.col("text"), F.col("base")).alias("scored"), model.vouched(F.col("text")).alias("vouched"))
    return rows.select("row", "found", "base", F.explode(F.array(both)).alias("_s")).select("row", "found", "base", "_s.*")


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The columns of ``docs`` with ``base`` (spans of the rules), ``added`` (spans that the trees select) and ``n_<kind>`` of ``base``.

    A span is ``start, kind, end``: code points, the end exclusive, the kind
    as its place in ``KINDS``. Null texts count as empty, an empty table gives
    no rows, a table without any candidate adds no spans, repeated rows get
    the same answer, columns named like the results are replaced. Without a
    ``model`` one is fitted, and the judged rows are written to the shared folder.
    """
    kinds = KINDS[:4]
    results = ["base", "added", *[f"n_{k}" for k in kinds]]
    docs = docs.drop(*results)
    if model is None:
        model = SpanModel.fit_trees(docs)
        rows = staged(_judged(docs, model), "pii-judged")
        model.calibrate(rows)
    else:
        rows = _judged(docs, model)
    added = F.explode(F.array(model.chosen(F.col("scored"), F.col("base")))).alias("added")
    return rows.select("row.*", "base", added, *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in kinds])


def redacted(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans become one."""
    found = find_personal_data(docs, model)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        return F.struct(
            F.when(fresh, F.concat(done["out"], F.array(
                F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.get(names, s["kind"])))).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(F.array_sort(F.concat("base", "added")), start, step,
                       lambda d: F.concat(F.array_join(d["out"], ""), F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), done)).select(docs.columns)
