"""Text features: cleaned text, words, n-gram counts, length-normalised weights.

A passage is one row, so its words, n-grams and counts are made within the
row, Arrow batch by Arrow batch; nothing is shuffled before terms are. A
word's lemma is found once per task, whatever the number of its occurrences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from leafsift.functions.distributed import explode_rows
from leafsift.functions.lemmas import lemma
from leafsift.functions.text import strip
from leafsift.functions.words import PRONOUNS, STOP_WORDS, SYMBOLS

# Numbers with inner points or commas, words of any script, ellipses, any other single character that is not white space.
WORD = r"\p{Nd}+(?:[.,]\p{Nd}+)*+|[\p{L}\p{M}\p{N}_]+|\.{3}|[^ \t\n\x0b\f\r\p{Z}\p{L}\p{M}\p{N}_]"
# Words that a task remembers before it starts anew.
MOST = 1 << 18
# Characters of the texts whose words are held as Python objects at a time.
PIECE = 1 << 20


def clean_text(text: Column | str) -> Column:
    """Trim, line ends to spaces, lower case."""
    return F.lower(F.translate(strip(text), "\n\r", "  "))


class _Reader:
    """Lemmas of the words of a cleaned text (pronouns as they are), without stop words and symbols."""

    def __init__(self):
        self.split, self.known = regex.compile(WORD).findall, {}
        self.dropped, self.pronouns = frozenset(STOP_WORDS + SYMBOLS), frozenset(PRONOUNS)

    def __call__(self, text: str) -> list[str]:
        known, out = self.known, []
        if len(known) > MOST:
            known.clear()
        for w in self.split(text):
            found = known.get(w)
            if found is None:
                found = w if w in self.pronouns else lemma(w)
                # The empty string stands for a word that is left out.
                found = known[w] = "" if found in self.dropped else found
            if found:
                out.append(found)
        return out


def _pieces(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """The texts in order, in pieces of about ``PIECE`` characters: a batch is so many rows, however long they are."""
    for texts in batches:
        piece, size = [], 0
        for text in texts:
            piece.append(text.as_py())
            size += len(piece[-1] or "")
            if size >= PIECE:
                yield piece
                piece, size = [], 0
        # An empty batch goes on as it is.
        if piece or not len(texts):
            yield piece


@F.arrow_udf(ArrayType(StringType()))
def _words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    read = _Reader()
    for texts in _pieces(batches):
        yield pa.array([None if t is None else read(t) for t in texts], pa.list_(pa.string()))


def words(text: Column | str) -> Column:
    """Lemmas of the lower-cased words (pronouns as they are), without stop words and symbols."""
    return _words(clean_text(text))


def joined_words(text: Column | str) -> Column:
    """The words but pronouns as one cleaned-up text."""
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(PRONOUNS)), " ")


def ngrams(tokens: list[str], low: int, high: int) -> Iterator[str]:
    """All n-grams with ``low <= n <= high``, words joined by a space."""
    for n in range(low, high + 1):
        yield from tokens if n == 1 else map(" ".join, zip(*(tokens[i:] for i in range(n))))


def term_counts(df: DataFrame, text: str = "text", ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """Add ``terms ARRAY<STRUCT<term, n>>``, the n-gram counts of each row, sorted by term; empty for a null text."""
    low, high = ngram_range

    @F.arrow_udf(ArrayType(StructType([StructField("term", StringType()), StructField("n", LongType())])))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _Reader()
        for texts in _pieces(batches):
            terms, counts, ends = [], [], [0]
            for t in texts:
                found = Counter(ngrams(read(t or ""), low, high))
                order = sorted(found)
                terms += order
                counts += [found[w] for w in order]
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)

    return df.withColumn("terms", counted(clean_text(text)))


def known_counts(df: DataFrame, theta: dict[str, tuple[float, float]], ngram_range: tuple[int, int] = (1, 1), text: str = "text") -> DataFrame:
    """Add ``counted``: sums ``t0, t1, squares`` over the terms in ``theta``, and the counts of all others as ``rest``."""
    low, high = ngram_range
    entry = StructType([StructField("term", StringType()), StructField("n", LongType())])
    held = df.sparkSession.sparkContext.broadcast(theta)

    @F.arrow_udf(StructType([*[StructField(c, DoubleType()) for c in ("t0", "t1", "squares")], StructField("rest", ArrayType(entry))]))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read, known = _Reader(), held.value
        for texts in _pieces(batches):
            sums, terms, counts, ends = [], [], [], [0]
            for t in texts:
                t0 = t1 = squares = 0.0
                found = Counter(ngrams(read(t or ""), low, high))
                for term in sorted(found):
                    n, own = found[term], known.get(term)
                    if own is None:
                        terms.append(term)
                        counts.append(n)
                    else:
                        t0, t1, squares = t0 + n * own[0], t1 + n * own[1], squares + n * n
                sums.append((t0, t1, squares))
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "n"])
            columns = [pa.array([row[i] for row in sums], pa.float64()) for i in range(3)]
            yield pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["t0", "t1", "squares", "rest"])

    return df.withColumn("counted", counted(clean_text(text)))


def norm(terms: Column | str) -> Column:
    """Euclidean length of the counts of a row."""
    squares = F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, t: acc + t["n"] * t["n"])
    return F.sqrt(squares.cast("double"))


def term_weights(counted: DataFrame) -> DataFrame:
    """One row per (row, term) with count ``n`` and weight ``w = n / length``."""
    return (
        counted.withColumn("_len", norm("terms"))
        .transform(explode_rows, F.col("terms"), "_t")
        .withColumn("term", F.col("_t.term"))
        .withColumn("n", F.col("_t.n"))
        .withColumn("w", F.col("n") / F.col("_len"))
        .drop("_t", "_len", "terms")
    )
