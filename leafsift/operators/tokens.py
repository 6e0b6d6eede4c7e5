"""Token annotation of cleaned blocks (printable ASCII), Arrow batch by Arrow batch.

Lemmas, parts of speech and entities come from closed lists and suffix rules
in place of a trained model, so they are approximations; ``annotator`` in
``annotate`` takes a model-backed pandas UDF instead. A word's facts are found
once per task, whatever the number of its occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from leafsift.functions.lemmas import lemma

# Possessive loops (``*+``) run without recursion in Java, however long a number is.
# One token with the space after it; a further run of spaces is a token of its own.
_TOKEN_BODY = (
    r"(?:[A-Za-z]\.){2,}|\d+(?:[.,:/]\d+)*+(?:[A-Za-z]\w*)?|[A-Za-z]\w*|'[A-Za-z]{1,2}\b|\.{2,}|[^ ]"
)
TOKEN = rf"((?:{_TOKEN_BODY}) ?| +)"

# Closed word lists of the annotation.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion trillion"
).split()
ADPOSITIONS = (
    "about above across after against along among around as at before behind below beneath beside between beyond "
    "by despite during except for from in including inside into like near of off on onto out outside over past per "
    "since through throughout to toward towards under until up upon via with within without"
).split()
SYMBOLS = list("$%+=<>*^~#@&|/")
PUNCTUATION = list("!\"'(),-.:;?[]_`{}\\") + ["..", "...", "/", "#", "%", "&", "*", "@"]
NOUN_ENDINGS = ["tion", "ment", "ness", "ance", "ence", "ship", "ity", "ees", "ee", "or"]
CURRENCIES = ["$", "usd", "eur", "gbp", "euro", "us$"]
COUNTRIES = (
    "argentina australia austria belgium brazil canada chile china colombia denmark egypt england finland france "
    "germany greece hungary india indonesia ireland israel italy japan kenya luxembourg malaysia mexico netherlands "
    "nigeria norway pakistan peru philippines poland portugal romania russia scotland singapore spain sweden "
    "switzerland thailand turkey uk u.k. ukraine usa u.s. u.s.a. vietnam wales europe asia africa london paris berlin"
).split()
PEOPLES = (
    "american argentinian australian austrian belgian brazilian british canadian chinese colombian danish dutch "
    "egyptian english finnish french german greek hungarian indian indonesian irish israeli italian japanese kenyan "
    "malaysian mexican nigerian norwegian polish portuguese romanian russian scottish spanish swedish swiss thai "
    "turkish ukrainian vietnamese welsh european asian african"
).split()
# One letter per part of speech and entity.
POS_LETTERS = {"ADP": "a", "SYM": "s", "NOUN": "n", "NUM": "d", "PUNCT": "p", "SPACE": "w", "X": "x"}
ENT_LETTERS = {"CARDINAL": "C", "PERCENT": "P", "MONEY": "M", "GPE": "G", "NORP": "R", "": "O"}


def split_tokens(text: str) -> list[str]:
    """The token rule for one short string on the driver, used for phrases of the registry."""
    found = re.findall(TOKEN, text, re.ASCII)
    return [t if t.startswith(" ") else t.rstrip(" ") for t in found]


NUMERAL = r"^(?:\d+(?:[.,]\d+)*+|\d+/\d+)$"


class WordFacts:
    """The rules for one raw token at a time, inside tasks: ``(text, lower, lemma, pos, like_num, is_punct, ent)``.

    The entity is None where it depends on the neighbours; ``entity`` then
    tells it from theirs. Facts are remembered per token, up to a bound.
    """

    def __init__(self, most: int = 1 << 17):
        self.most, self.known = most, {}
        self.numeral = re.compile(NUMERAL.replace("$", r"\Z"), re.ASCII).match
        self.endings = tuple(NOUN_ENDINGS)

    def __call__(self, raw: str) -> tuple:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > self.most:
                self.known.clear()
            found = self.known[raw] = self._facts(raw)
        return found

    def _facts(self, raw: str) -> tuple:
        text = raw if raw.startswith(" ") else raw.rstrip(" ")
        low = text.lower()
        number = low in NUMBER_WORDS or self.numeral(low) is not None
        pos = ("NUM" if number else "ADP" if low in ADPOSITIONS else "SYM" if low in SYMBOLS else "PUNCT" if low in PUNCTUATION
               else "SPACE" if low.startswith(" ") else "NOUN" if low.endswith(self.endings) else "X")
        ent = None if number or low in ("%", "percent") else "GPE" if low in COUNTRIES else "NORP" if low in PEOPLES else ""
        return text, low, lemma(low), pos, number, low in PUNCTUATION, ent

    def entity(self, word: tuple, before: tuple | None, after: tuple | None) -> str:
        if word[4]:
            if after and after[1] in ("%", "percent"):
                return "PERCENT"
            return "MONEY" if before and before[1] in CURRENCIES else "CARDINAL"
        return "PERCENT" if before and before[4] else ""


TOKENS = ArrayType(StructType([StructField(n, StringType()) for n in ("text", "lower", "lemma", "pos", "ent")]
                              + [StructField(n, BooleanType()) for n in ("like_num", "is_punct")]))


@F.arrow_udf(TOKENS)
def _annotated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    facts, split = WordFacts(), re.compile(TOKEN, re.ASCII).findall
    kinds = [pa.string()] * 5 + [pa.bool_()] * 2
    for texts in batches:
        rows, ends, missing = [], [0], []
        for text in texts:
            words = [facts(t) for t in split(text.as_py())] if text.is_valid else []
            for i, w in enumerate(words):
                ent = w[6] if w[6] is not None else facts.entity(w, words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None)
                rows.append((*w[:4], ent, *w[4:6]))
            missing.append(not text.is_valid)
            ends.append(len(rows))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        tokens = pa.StructArray.from_arrays(columns, ["text", "lower", "lemma", "pos", "ent", "like_num", "is_punct"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, mask=pa.array(missing))


def annotate(blocks: DataFrame, annotator: Callable[[Column], Column] | None = None, text: str = "text") -> DataFrame:
    """Add ``tokens ARRAY<STRUCT<text, lower, lemma, pos, ent, like_num, is_punct>>`` to blocks; null where the text is.

    ``annotator`` maps the text column to a token array of that shape, e.g. a
    pandas UDF that runs a language model on Arrow batches.
    """
    return blocks.withColumn("tokens", (annotator or _annotated)(F.col(text)))
