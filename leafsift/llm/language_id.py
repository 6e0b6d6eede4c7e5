"""Language identification by Bayesian evidence fusion.

Four pieces of evidence meet: what letter trigrams of the text say, the
declared language (an attribute of the markup, a column), the suffix of the
address, and the host. How far a declaration can be trusted, and what hosts
and suffixes speak, is learned from the whole table by grouped aggregation of
the texts' own posteriors: a host's prior shrinks towards that of its suffix,
and that towards the whole table's.

One more class, ``other``, has no letter habits at all. A text that looks
like it is in none of the languages, that has no letters, or whose best
language stays below the least posterior, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import staged

BUCKETS = 1 << 16
#: Characters of a long text per step.
PART = 1 << 20
#: ASCII that isn't a letter parts words; bytes of other characters stay.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
OTHER = "other"
OTHER_PRIOR = 1e-3
#: The two-letter language codes of ISO 639.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj "
    "fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky "
    "la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru "
    "rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo "
    "za zh zu").split()
#: Rows that the trigram model is fitted on, expected, and the least of each language; and strengths of the priors, in documents.
FIT_ROWS, LEAST_ROWS, SUFFIX_STRENGTH, HOST_STRENGTH = 20_000, 50, 50.0, 20.0
#: Trigrams overlap and repeat: n of them count as n / (3 + n / 100) independent ones, so as 100 at most.
OVERLAP, MOST = 3.0, 100.0


def trigram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the letter trigrams of a whole text, part by part; words keep a space on either side."""
    for at in range(0, len(text), PART):
        b = np.frombuffer((" " + text[at : at + PART].lower() + " ").encode("utf-8", "replace").translate(LETTERS), np.uint8)
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
        if len(b) >= 3:
            code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
            yield (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over ``lang, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in trigram_buckets(text.as_py() or ""):
                    own += np.bincount(part, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    each = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log-likelihoods of trigram buckets by language; the last class is ``other``."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @staticmethod
    def fit(labelled: DataFrame, rows: int = FIT_ROWS, codes: Sequence[str] = CODES) -> TextModel:
        """Fit on about ``rows`` rows of ``lang, text`` (all, if there are fewer), dealt evenly to the languages of the whole table.

        Only ``codes`` are languages: tags such as ``und`` or ``zxx``, or of no
        meaning, say nothing about a text, however many rows bear them, and the
        number of classes is bounded by the list. Languages are counted over all rows with letters. Those with fewer rows than their part enter whole, the others by
        hash of the text and, if there is one, of ``doc_id``; each with the rows of its least hash at any rate.
        """
        labelled = labelled.filter(F.col("lang").isin(list(codes)) & F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"))
        drawn = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in labelled.columns], F.lit("fit")), F.lit(1 << 30))
        labelled = labelled.select("lang", "text", drawn.alias("_drawn"))
        sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_drawn").alias("least")).collect()
        part, left = 0.0, float(rows)
        for i, n in enumerate(sorted(r["n"] for r in sizes)):  # what small languages leave goes to the larger ones
            part = max(part, left / (len(sizes) - i))
            left -= min(n, part)
        part = max(part, LEAST_ROWS)
        languages = sorted(r["lang"] for r in sizes)
        bounds = labelled.sparkSession.createDataFrame(
            [(r["lang"], max(r["least"], int(min(1.0, part / r["n"]) * (1 << 30)) - 1)) for r in sizes], "lang string, _bound long")
        sample = labelled.join(F.broadcast(bounds), "lang").filter("_drawn <= _bound")
        counts = trigram_counts(sample).toArrow().to_pandas()  # at most BUCKETS rows a language
        table = np.full((BUCKETS, len(languages) + 1), 1.0 / BUCKETS)
        for i, lang in enumerate(languages):
            own = counts[counts["lang"] == lang]
            n = np.full(BUCKETS, 0.5)
            n[own["bucket"].to_numpy()] += own["n"].to_numpy()
            table[:, i] = n / n.sum()
        return TextModel(languages, np.log(table).astype(np.float32))

    def evidence(self, text: str | None) -> np.ndarray | None:
        """Log-likelihood of each class, tempered for overlap; None for a text without letters."""
        total, n = np.zeros(self.table.shape[1]), 0
        for part in trigram_buckets(text or ""):
            total += self.table[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return total / (OVERLAP + n / MOST) if n else None


def posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max())
    return e / e.sum()


def _main(declared: Column, languages: list[str]) -> Column:
    """Primary part of a declared language; a language that the model lacks is ``other``, a tag that names none is null, as is nothing."""
    tag = F.lower(F.regexp_extract(F.trim(F.coalesce(declared, F.lit(""))), "^[A-Za-z]+", 0))
    return F.when(tag.isin(languages), tag).when(tag.isin(CODES), OTHER)


def suffix_of(host: Column) -> Column:
    """What follows the last dot of a host; empty if there is none."""
    return F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1))).otherwise("")


def text_posteriors(rows: DataFrame, model: TextModel) -> DataFrame:
    """``declared, host, p`` for every row with letters."""
    table, languages = model.table, model.languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel(languages, table)
        for batch in batches:
            each = [own.evidence(t.as_py()) for t in batch.column(2)]
            keep = pa.array([e is not None for e in each])
            kept = batch.filter(keep)
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array([posterior(e).tolist() for e in each if e is not None], pa.list_(pa.float64()))],
                ["declared", "host", "p"])

    return rows.select("declared", "host", "text").mapInArrow(score, "declared string, host string, p array<double>")


class Fusion:
    """A text model with what the whole table says about declarations, suffixes and hosts."""

    def __init__(self, model: TextModel, rows: DataFrame):
        """``rows``: ``text, declared, host`` of the whole table."""
        self.model = model
        k = len(model.languages) + 1
        sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
        p = text_posteriors(rows.withColumn("declared", _main(F.col("declared"), model.languages)), model)
        # Every later sum starts from the sums per declaration and host.
        each = staged(p.withColumn("host", F.coalesce("host", F.lit(""))).groupBy("declared", "host").agg(*sums), "language-sums")

        def summed(frame: DataFrame, *by: str) -> DataFrame:
            return frame.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])

        total = np.array([x or 0.0 for x in summed(each).first()]) + 1.0
        prior = total / total.sum() * (1 - OTHER_PRIOR)
        prior[-1] = OTHER_PRIOR
        self.prior = prior / prior.sum()
        seen = {r["declared"]: np.array(r[1:]) for r in summed(each.filter("declared IS NOT NULL"), "declared").collect()}
        count = {d: seen.get(d, np.zeros(k)) + 1.0 for d in [*model.languages, OTHER]}
        given = sum(count.values())
        self.declared = {d: np.log(n / given).tolist() for d, n in count.items()}

        def smoothed(parent, strength: float) -> list[Column]:
            n = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
            return [((F.col(f"s{i}") + strength * parent(i)) / (n + strength)).alias(f"q{i}") for i in range(k)]

        hosts = summed(each, "host").withColumn("suffix", suffix_of(F.col("host")))
        suffixes = summed(hosts, "suffix").select("suffix", *smoothed(lambda i: F.lit(float(self.prior[i])), SUFFIX_STRENGTH))
        self.hosts = staged(
            hosts.join(suffixes, "suffix").select(
                F.col("host").alias("_host"),
                F.array(*smoothed(lambda i: F.col(f"q{i}"), HOST_STRENGTH)).alias("_prior")), "host-priors")

    def identify(self, rows: DataFrame, carried: list[str], least: float = 0.5) -> DataFrame:
        """Add ``language, probability, text_language, rejected`` to the ``carried`` columns of ``rows`` (with ``text, declared, host``)."""
        table, languages, declared = self.model.table, self.model.languages, self.declared
        # Joined on the host: Spark broadcasts the hosts if they are few, else splits hot hosts.
        own = rows.withColumn("_tag", _main(F.col("_declared"), languages)).withColumn("_at", F.coalesce("_given_host", F.lit("")))
        joined = own.join(self.hosts, F.col("_at") == F.col("_host"), "left").select(*carried, "_text", "_tag", "_prior")
        base = self.prior.tolist()

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, names = TextModel(languages, table), [*languages, OTHER]
            for batch in batches:
                text, tag, prior = batch.columns[-3:]
                out: list[tuple] = []
                for t, d, p in zip(text, tag.to_pylist(), prior.to_pylist()):
                    e = model.evidence(t.as_py())
                    if e is None or not languages:
                        out.append((None, None, None, e is None))
                        continue
                    fused = posterior(e + np.log(p or base) + np.array(declared.get(d, 0.0)))
                    best = int(fused.argmax())
                    out.append((names[best], float(fused[best]), names[int(e.argmax())], names[best] == OTHER or fused[best] < least))
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = [pa.string(), pa.float64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                                 [*carried, "language", "probability", "text_language", "rejected"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(carried).schema)
        return joined.mapInArrow(decide, (fields + ", " if fields else "") + "language string, probability double, text_language string, rejected boolean")


def identify_languages(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
                       model: TextModel | None = None, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` with ``language, probability, text_language, rejected``.

    Without a ``model``, one is fitted on rows of ``docs`` with a declared
    language of ``CODES`` (pass a model fitted with ``codes`` of your own for
    others). Texts that are null, empty or without letters have null results
    and are rejected; null declarations and unknown hosts leave the decision
    to the rest; a table in which no language is declared rejects only texts
    without letters; repeated rows get the same result; empty tables give no
    rows; columns named like the results are replaced.
    """
    results = {"language", "probability", "text_language", "rejected"}
    carried = [c for c in docs.columns if c not in results]
    names = {c: f"_k{i}" for i, c in enumerate(carried)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("_text"),
                       F.col(declared).cast("string").alias("_declared"), F.col(host).cast("string").alias("_given_host"))
    ids = [F.col(names["doc_id"]).alias("doc_id")] if "doc_id" in names else []
    plain = rows.select(F.col("_text").alias("text"), F.col("_declared").alias("declared"), F.col("_given_host").alias("host"), *ids)
    model = model or TextModel.fit(plain.withColumn("lang", F.lower(F.regexp_extract("declared", "^[A-Za-z]+", 0))).filter("lang <> ''"))
    found = Fusion(model, plain).identify(rows, list(names.values()), least)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], *sorted(results))


def in_known_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return identify_languages(docs, least=least).filter(~F.col("rejected")).select(docs.columns)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def markup_language(html: Column) -> Column:
    """The ``lang`` attribute of the html element; null if there is none."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(tag != "", tag)


