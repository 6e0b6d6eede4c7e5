"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of a text's tokens (words parted by one space) and an
end. Contexts of up to ``DEPTH`` symbols are counted over the whole training
corpus. As in the classical algorithm a context is a candidate if it occurs
often enough, and is retained if the divergence of its next-symbol
distribution from that of its parent (the context without its oldest symbol)
outweighs its parameters. The least number of occurrences grows with the
square root of the corpus (``least_count``), so contexts become more as the
corpus grows, while the tree grows slowly enough to be held by every task.
Distributions are smoothed towards the parent's.
The tree becomes an automaton whose states are the longest retained suffixes,
and a text is scored by walking it.

The unigram base score needs the count of every token. Frequent words are
held in the tasks: a vocabulary of at most ``HEAD_WORDS``, chosen from a
sample and counted exactly. All other words meet their counts in a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsift.llm.common import only, staged

DEPTH, LEAST_SHARE, LEAST_ROOT = 6, 2e-5, 0.1
BASE, END = 257, 256
HEAD_WORDS, SAMPLE_ROWS = 200_000, 10_000
#: Bytes of text that a task works on at a time; symbols per piece of the walk.
CHUNK, PIECE = 1 << 20, 1024
#: A-Z to a-z, white space to spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def least_count(total: int) -> float:
    """Occurrences that a context needs in a corpus of ``total`` symbols: a share of a small corpus, a multiple of the root of a larger one."""
    return min(LEAST_SHARE * total, LEAST_ROOT * total**0.5)


def tokens_of(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, parted by single spaces."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(PLAIN).split())


def held_out(doc_id: int | None) -> bool:
    """Whether a document stays out of training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: the key tells rows apart, equal rows share it."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), "text")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of about ``CHUNK`` bytes of tokens: id, key, tokens."""
    rows, size = [], 0
    for batch in batches:
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            rows.append((doc_id, key, tokens_of(text.as_py())))
            size += len(rows[-1][2])
            if size >= CHUNK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def symbols(texts: list[bytes], lead: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, each with ``lead`` ends before and one after it; and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64) + lead + 1
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), END, np.int64)
    for s, t in zip(starts, texts):
        out[s + lead : s + lead + len(t)] = np.frombuffer(t, np.uint8)
    return out, starts


class GramCounts:
    """Counts of numbers, kept sorted. What is new is merged in when it is half as much as what is kept, so merging costs little and memory follows the distinct numbers."""

    def __init__(self, least: int = 500_000):
        self.kept = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.least = least

    def add(self, values: np.ndarray) -> None:
        self.new.append(np.unique(values, return_counts=True))
        if sum(len(v) for v, _ in self.new) > max(self.least, len(self.kept[0]) // 2):
            self.merged()

    def merged(self, pieces: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Merge range by range of the numbers, so that little is held twice."""
        parts, self.new = [self.kept, *self.new], []
        largest = max((p[0] for p in parts), key=len)
        bounds = largest[len(largest) // pieces :: max(1, len(largest) // pieces)]
        cuts = [[0, *np.searchsorted(v, bounds), len(v)] for v, _ in parts]
        out = []
        for k in range(len(bounds) + 1):
            values = np.concatenate([v[c[k] : c[k + 1]] for (v, _), c in zip(parts, cuts)])
            counts = np.concatenate([n[c[k] : c[k + 1]] for (_, n), c in zip(parts, cuts)])
            if len(values):
                order = np.argsort(values, kind="stable")
                values, counts = values[order], counts[order]
                first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
                out.append((values[first], np.add.reduceat(counts, first)))
        if out:
            self.kept = np.concatenate([v for v, _ in out]), np.concatenate([n for _, n in out])
        return self.kept


def context_grams(texts: list[bytes]) -> np.ndarray:
    """Each symbol with the ``DEPTH`` before it, as one number in base 257."""
    s, starts = symbols(texts, DEPTH)
    code = np.zeros(len(s) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code = code * BASE + s[k : len(s) - DEPTH + k]
    own = np.ones(len(code), bool)  # windows that reach from one text into the next are none
    for d in range(DEPTH):
        at = starts[1:] - DEPTH + d
        own[at[at >= 0]] = False
    return code[own]


STATISTICS = "kind string, code long, word binary, key long, n long, train boolean"


def statistics(rows: DataFrame, head: list[bytes]) -> DataFrame:
    """One pass over the texts: context grams (kind g) and frequent words (h) of training documents, rare words of all (t)."""
    sent = rows.sparkSession.sparkContext.broadcast(head)
    names = [c.split()[0] for c in STATISTICS.split(", ")]

    def frame(kind: str, n, code=None, word=None, key=None, train=None) -> pa.RecordBatch:
        size = len(n)
        none = lambda v, t: pa.nulls(size, t) if v is None else pa.array(v, t)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * size, pa.string()), none(code, pa.int64()), none(word, pa.binary()), none(key, pa.int64()),
             pa.array(n, pa.int64()), none(train, pa.bool_())], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = {w: i for i, w in enumerate(sent.value)}
        grams, heads = GramCounts(), np.zeros(len(frequent) + 1, np.int64)
        for rows in chunks(batches):
            training = []
            rare: list[tuple] = []
            for doc_id, key, text in rows:
                train = not held_out(doc_id)
                own = Counter(text.split(b" ")) if text else {}
                if train:
                    training.append(text)
                    heads[-1] += 1
                for word, n in own.items():
                    at = frequent.get(word)
                    if at is None:
                        rare.append((word, key, n, train))
                    elif train:
                        heads[at] += n
            if training:
                grams.add(context_grams(training))
            if rare:
                word, key, n, train = zip(*rare)
                yield frame("t", n, word=word, key=key, train=train)
        codes, counts = grams.merged()
        for i in range(0, len(codes), 100_000):
            yield frame("g", counts[i : i + 100_000], code=codes[i : i + 100_000])
        at = np.flatnonzero(heads)
        yield frame("h", heads[at], code=at)

    return rows.mapInArrow(gather, STATISTICS)


def frequent_words(rows: DataFrame) -> list[bytes]:
    """Words to hold in the tasks: the most frequent in a sample of about ``SAMPLE_ROWS`` rows, seen twice or more in it."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("key", F.lit("drawn")), F.lit(1 << 30)) < int(share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            own: Counter = Counter()
            for _, _, text in rows:
                own.update(text.split(b" ") if text else ())
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["word", "n"])

    each = rows.filter(drawn).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    each = staged(each, "lm-sample")
    # The least count that leaves HEAD_WORDS at most; there are few different counts.
    least, words = 2, 0
    for r in sorted(each.groupBy("n").count().collect(), reverse=True):
        words += r["count"]
        if words > HEAD_WORDS:
            least = r["n"] + 1
            break
    return sorted(each.filter(F.col("n") >= least).select("word").toArrow().column(0).to_pylist())


class SuffixTree:
    """States with their transitions and log10 probabilities; the last column is for symbols never seen in training."""

    def __init__(self, symbol_class: np.ndarray, step: np.ndarray, logs: np.ndarray):
        self.symbol_class, self.step, self.logs = symbol_class, step, logs

    @staticmethod
    def grow(grams: DataFrame) -> SuffixTree:
        """From ``code, n`` over all windows of ``DEPTH`` symbols and the one after them."""
        total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        levels = {}
        for depth in range(DEPTH, -1, -1):
            level = levels[depth + 1].select((F.col("code") % BASE ** (depth + 1)).alias("code"), "n") if depth < DEPTH else grams
            level = level.groupBy("code").agg(F.sum("n").alias("n"))
            levels[depth] = staged(level.withColumn("context", F.expr(f"code div {BASE}")), "lm-contexts")
        kept = set()  # at most DEPTH * total / least_count(total) contexts
        for depth in range(1, DEPTH + 1):
            parent = levels[depth - 1].groupBy("context").agg(F.sum("n").alias("total"))
            up = levels[depth - 1].join(parent, "context").select(F.col("code").alias("up"), (F.col("n") / F.col("total")).alias("p"))
            own = levels[depth].groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            own = own.filter(F.col("total") >= F.lit(least_count(total)))
            gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("p")))
            each = (
                levels[depth].join(own, "context").withColumn("up", F.col("code") % BASE**depth).join(up, "up")
                .groupBy("context").agg(gain.alias("gain"), F.first("total").alias("total"), F.first("kinds").alias("kinds"))
                .filter(F.col("gain") > (F.col("kinds") - 1) * F.log("total") / 2))
            kept |= {(depth, c) for c in each.select("context").toArrow().column(0).to_pylist()}
        states = {(0, 0)}
        for depth, context in kept:  # with all their parts, which are at least as frequent
            for low in range(depth):
                for width in range(1, depth - low + 1):
                    states.add((width, context // BASE**low % BASE**width))
        spark = grams.sparkSession
        wanted = spark.createDataFrame(sorted(states), "depth int, context long")
        all_levels = None
        for depth, level in levels.items():
            part = level.withColumn("depth", F.lit(depth))
            all_levels = part if all_levels is None else all_levels.unionByName(part)
        found = all_levels.join(F.broadcast(wanted), ["depth", "context"]).select("depth", "context", "code", "n").toArrow().to_pandas()
        return SuffixTree.build(sorted(states), found)

    @staticmethod
    def build(states: list[tuple[int, int]], found: pd.DataFrame) -> SuffixTree:
        """``states`` by depth, root first; ``found``: next-symbol counts of each state."""
        number = {s: i for i, s in enumerate(states)}
        seen = sorted(set((found["code"] % BASE).tolist()) - {END})
        symbol_class = np.full(BASE, len(seen) + 1)  # the end's class is 0, unseen symbols share the last
        symbol_class[seen] = np.arange(1, len(seen) + 1)
        symbol_class[END] = 0
        width = len(seen) + 2
        counts = np.zeros((len(states), width))
        row = np.array([number[k] for k in zip(found["depth"], found["context"])], np.int64)
        np.add.at(counts, (row, symbol_class[(found["code"] % BASE).to_numpy(np.int64)]), found["n"].to_numpy(float))
        p, step = np.zeros((len(states), width)), np.zeros((len(states), width), np.int32)
        for i, (depth, context) in enumerate(states):
            own = counts[i]
            if depth == 0:
                unseen = BASE - width + 1
                p[i] = (own + 1) / (own.sum() + BASE)
                p[i, -1] = 1 / (own.sum() + BASE) if unseen else 0  # one of the unseen symbols
                continue
            up = number[(depth - 1, context % BASE ** (depth - 1))]
            kinds = (own > 0).sum()
            p[i] = (own + kinds * p[up]) / (own.sum() + kinds)
        longer: dict[int, list[tuple[int, int]]] = {}
        for i, (depth, context) in enumerate(states):
            if depth:
                longer.setdefault(number[(depth - 1, context // BASE)], []).append((symbol_class[context % BASE], i))
        for i, (depth, context) in enumerate(states):
            if depth:  # as the parent, unless the longer context is a state as well
                step[i] = step[number[(depth - 1, context % BASE ** (depth - 1))]]
            for symbol, state in longer.get(i, ()):
                step[i, symbol] = state
        with np.errstate(divide="ignore"):
            return SuffixTree(symbol_class, step, np.log10(p).astype(np.float32))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end. Pieces of all texts are walked side by side."""
        s, starts = symbols(texts, DEPTH)
        s = self.symbol_class[s].astype(np.int16)
        ends = np.append(starts[1:], len(s))
        at, owner = [], []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            for lo in range(a, b - DEPTH, PIECE):
                at.append(lo)
                owner.append(i)
        at, owner = np.array(at, np.int64), np.array(owner, np.int64)
        size = np.minimum(ends[owner] - at, PIECE + DEPTH)
        order = np.argsort(-size, kind="stable")
        at, owner, size = at[order], owner[order], size[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
        for d in range(int(size[0]) if len(size) else 0):
            live = np.searchsorted(-size, -d, "left")  # pieces are ordered, longest first
            now = s[at[:live] + d]
            if d >= DEPTH:
                total[:live] += self.logs[state[:live], now]
            state[:live] = self.step[state[:live], now]
        return np.bincount(owner, total, len(texts))


SCORED = "doc_id long, key long, held_out boolean, n_tokens long, head_known long, head_logs double, tail long, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` but the held-out ones and score all of them.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for every row. Null and empty texts have the end token alone;
    equal rows train as often as they occur and score alike; a null id counts
    as the empty text when it comes to holding out; an empty table gives no
    rows; further columns are left out.
    """
    rows = keyed(docs)
    head = frequent_words(rows)
    found = staged(statistics(rows, head), "lm-statistics", "kind")
    counts = np.zeros(len(head) + 1, np.int64)  # of the frequent words and, last, the end
    of_head = found.filter("kind = 'h'").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts[of_head.column("code").to_numpy()] = of_head.column("n").to_numpy()
    tree = SuffixTree.grow(found.filter("kind = 'g'").select("code", "n"))

    rare = found.filter("kind = 't'").select("word", "key", "n", "train")
    in_training = F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).over(Window.partitionBy(F.xxhash64("word"), "word"))
    counted = rare.withColumn("c", in_training)
    tails = staged(
        counted.groupBy("key").agg(
            F.sum("n").alias("tokens"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
            F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs")), "lm-tails")
    rare_sums = rare.filter("train").groupBy("word").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens = rare_sums[1] + int(counts.sum())
    distinct = rare_sums[0] + int((counts > 0).sum())
    sent = rows.sparkSession.sparkContext.broadcast((head, counts, tree.symbol_class, tree.step, tree.logs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, *parts = sent.value
        model, frequent, logs = SuffixTree(*parts), {w: i for i, w in enumerate(head)}, np.log10(counts + 1.0)
        for rows in chunks(batches):
            out = []
            scores = model.scores([text for _, _, text in rows])
            for (doc_id, key, text), own in zip(rows, scores.tolist()):
                words = text.split(b" ") if text else []
                at = np.fromiter(map(frequent.get, words, repeat(-1)), np.int64, len(words))
                at = np.append(at[at >= 0], len(head))  # and the end
                out.append((doc_id, key, held_out(doc_id), len(words) + 1, int((counts[at] > 0).sum()), float(logs[at].sum()),
                            len(words) + 1 - len(at), own))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             [c.split()[0] for c in SCORED.split(", ")])

    scored = rows.mapInArrow(score, SCORED).join(tails, "key", "left")
    # Equal rows share a key, and the sums of their rare words: each takes its part.
    part = F.coalesce(F.col("tail") / F.col("tokens"), F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.round(F.coalesce("known", F.lit(0)) * part)).cast("long").alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) * part
         - F.col("n_tokens") * F.log10(F.lit(float(train_tokens + distinct + 1)))).alias("base_score"),
        "score")
