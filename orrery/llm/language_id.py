"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet as log-odds: the text's likelihood under byte-trigram models, the language that the markup
declares, the address's suffix, and a prior of the host. The models are fitted on a bounded sample of labelled texts.
Host priors come from grouped aggregation over all rows: a row's text gives it soft counts, which are summed by host,
by registered domain and over all; a host's prior is smoothed towards its domain's, and that towards the whole, and a
row's own counts are taken out of what it is told. How far declarations and suffixes are believed is measured the same
way: over all rows, by how often the text agrees with them.

The likelihood of a long text is tempered, as trigrams are not independent. Texts are read whole, once; what is joined
and grouped is a few numbers a row.

A row's numbers are fused in numpy, a batch at a time. Hosts' counts are looked up by host and one of ``SALTS`` salts,
so that a host with a third of all rows is read in several tasks.

Defined results: missing evidence (a null or empty text, no declaration, no address) counts for nothing, and a row
without any gets the overall prior; equal rows get equal results; an empty table gives an empty result; languages are
those of the labelled sample, and where no text is labelled there are none: lang and confidence are null. More than
``MAX_LANGUAGES`` labels raise an error. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, small_batches

CELLS = 1 << 15
#: Different labelled texts of each language that the models are fitted on, at most.
FIT_ROWS = 400
#: Trigrams after which a text's likelihood hardly grows.
TEMPER = 150.0
#: Pseudo-rows of the prior that a host, a domain, a declaration or a suffix is smoothed with.
STRENGTH = 8.0
#: Different labels that models are fitted for, at most: each has ``CELLS`` numbers in what is broadcast.
MAX_LANGUAGES = 1000
#: Places that a host's counts are read in.
SALTS = 16
#: How sure a declaration is of the language it names, where few texts bear it.
NAMED = 0.7

TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&#?\w+;")


def visible(html: str | None) -> str:
    """The text between tags."""
    return ENTITY.sub(" ", TAGS.sub(" ", html or "")) if html and "<" in html else html or ""


def trigrams(text: str) -> np.ndarray:
    """Cells of the text's byte trigrams, blanks run together and case folded."""
    b = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64)


@dataclass
class Models:
    languages: list[str]
    logs: np.ndarray  # (CELLS, languages)

    def evidence(self, text: str) -> np.ndarray:
        """Tempered log-likelihoods, the highest 0."""
        cells = trigrams(text)
        if not len(cells):
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for i in range(0, len(cells), 1 << 18):
            total += self.logs[cells[i : i + (1 << 18)]].sum(0)
        total *= 1 / (1 + len(cells) / TEMPER)
        return total - total.max()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Models:
    """Trigram models of at most ``rows`` different texts of each language, those with the smallest hashes; copies count
    once."""
    hashed = [F.xxhash64("t", F.lit(31)).alias("h"), F.xxhash64("t", F.lit(32)).alias("g")]
    given = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("t"))
    given = given.select("lang", "t", *hashed)
    keys = cut(given.select("lang", "h", "g").distinct())
    known = cut(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    if known.count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; are these languages?")
    counts = F.broadcast(known)
    # Of a large language, about twice the wanted texts are ranked (fewer than wanted has a chance below 1e-50 at 400).
    low = F.pmod(F.col("h"), F.lit(1 << 30))
    some = keys.join(counts, "lang").where((F.col("n") <= 2 * max(rows, 400)) | (low < F.lit(2.0 * max(rows, 400)) / F.col("n") * (1 << 30)))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(low, "h", "g")))
    chosen = F.broadcast(ranked.where(F.col("rank") <= rows).select("lang", "h", "g"))
    picked = given.join(chosen, ["lang", "h", "g"]).groupBy("lang", "h", "g").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(g, np.zeros(CELLS, np.int64))
                np.add.at(sums[g], trigrams(t), 1)
        for g, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "cell", "n"])

    small_batches(labelled.sparkSession)
    found = picked.select("lang", "t").mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    c = np.full((CELLS, len(languages)), 0.05)
    np.add.at(c, (found["cell"].to_numpy(np.int64), np.searchsorted(languages, found["lang"].to_numpy(str))), found["n"].to_numpy(float))
    return Models(languages, np.log(c / c.sum(0)))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def declared_in(html: Column) -> Column:
    """The primary language of the markup's lang attribute."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def smooth(n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Counts (rows) as probabilities, smoothed towards a prior."""
    n = np.maximum(n, 0.0)
    return (n + prior * STRENGTH) / (n.sum(axis=-1, keepdims=True) + STRENGTH)


def posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Evidence:
    """What rows are fused with: the overall prior, and by language the counts of texts that bear its declaration."""

    languages: list[str]
    base: np.ndarray  # (languages,)
    borne: np.ndarray  # (languages, languages)

    def fuse(self, logs: np.ndarray, soft: np.ndarray, host: Sequence[np.ndarray | None], domain: Sequence[np.ndarray | None], suffix: Sequence[np.ndarray | None], declared: Sequence[str | None]) -> np.ndarray:
        """Posteriors (rows). ``soft``: the texts' own counts, 0 without a text, taken out of all that a row is told.
        host, domain and suffix: their counts, or None."""
        n = len(self.languages)
        counts = lambda xs: (np.stack([np.zeros(n) if x is None else x for x in xs]), np.array([x is not None for x in xs])[:, None])
        prior = np.broadcast_to(self.base, logs.shape)
        for level in (suffix, domain, host):
            known, there = counts(level)
            prior = np.where(there, smooth(known - soft, prior), prior)
        at = {x: i for i, x in enumerate(self.languages)}
        said = np.array([at.get(x, -1) for x in declared])
        named = np.full((n, n), (1 - NAMED) / max(1, n - 1))
        np.fill_diagonal(named, NAMED)
        told = np.log(smooth(self.borne[said] - soft, named[said]) / self.base)
        return posterior(logs + np.log(prior) + np.where(said[:, None] < 0, 0.0, told))


def sums(column: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.col(column)[i]), F.lit(0.0)) for i in range(n)])


def identify(rows: DataFrame, models: Models, ids: Sequence[str], markup: Column | None = None) -> DataFrame:
    """``rows``: the id columns, text, declared, host (null where unknown). Tags are stripped from texts where ``markup``
    holds (by default everywhere); others are read as they are. Appends lang, confidence
    and text_lang (what the text alone says, null without one)."""
    n, languages = len(models.languages), models.languages
    if not n:
        none = F.lit(None)
        return rows.select(*ids, none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"))
    held = rows.sparkSession.sparkContext.broadcast(models)
    given = rows.select(*ids, F.col("declared").cast("string").alias("declared"), F.col("host").cast("string").alias("host"), (F.lit(True) if markup is None else markup).alias("_markup"), F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked, texts = (b.column(b.num_columns - i).to_pylist() for i in (2, 1))
            logs = [held.value.evidence(visible(t) if m else t or "") for m, t in zip(marked, texts, strict=True)]
            soft = [posterior(x).tolist() if x.min() < 0 else None for x in logs]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([x.tolist() for x in logs], kind), pa.array(soft, kind)], names=[*b.schema.names[:-2], "logs", "soft"])

    small_batches(rows.sparkSession)
    schema = given.drop("_markup", "_text").schema.add("logs", T.ArrayType(T.DoubleType())).add("soft", T.ArrayType(T.DoubleType()))
    domain = F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)).otherwise(F.col("host"))
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1))
    scored = cut(given.mapInArrow(run, schema).withColumns({"_domain": domain, "_suffix": suffix}))
    whole = np.array(scored.agg(sums("soft", n).alias("all")).first()[0], float)
    # One row a host: its own counts, its domain's and its suffix's. Rows without a host need no join.
    hosts = scored.where("host is not null").groupBy("host", "_domain", "_suffix").agg(sums("soft", n).alias("host_n"))
    for column in ("_domain", "_suffix"):
        hosts = hosts.join(hosts.where(f"{column} is not null").groupBy(column).agg(sums("host_n", n).alias(f"{column}_n")), column, "left")
    hosts = cut(hosts.select("host", "host_n", "_domain_n", "_suffix_n"))
    # Declarations of other languages than the models' tell nothing.
    borne = np.zeros((n, n))
    for r in scored.where(F.col("declared").isin(languages)).groupBy("declared").agg(sums("soft", n).alias("n")).collect():  # a row a language
        borne[languages.index(r["declared"])] = r["n"]
    told = rows.sparkSession.sparkContext.broadcast(Evidence(languages, smooth(whole, np.full(n, 1.0 / n)), borne))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            matrix = lambda c: np.array([[0.0] * n if x is None else x for x in at[c].to_pylist()])  # noqa: B023, E731
            lists = lambda c: [None if x is None else np.array(x) for x in at[c].to_pylist()]  # noqa: B023, E731
            soft = matrix("soft")
            p = told.value.fuse(matrix("logs"), soft, *(lists(c) for c in ("host_n", "_domain_n", "_suffix_n")), at["declared"].to_pylist())
            best = [languages[i] for i in p.argmax(axis=1)]
            alone = [None if x is None else languages[int(np.argmax(x))] for x in at["soft"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(ids))), pa.array(best, pa.string()), pa.array(p.max(axis=1)), pa.array(alone, pa.string())], names=[*ids, "lang", "confidence", "text_lang"])

    salt = F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")
    spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = scored.withColumn("_salt", salt).where("host is not null").join(spread, ["host", "_salt"])
    none = F.lit(None).cast(T.ArrayType(T.DoubleType()))
    columns = [*ids, "declared", "logs", "soft", "host_n", "_domain_n", "_suffix_n"]
    alone = scored.where("host is null").withColumns({c: none for c in ("host_n", "_domain_n", "_suffix_n")})
    out = rows.select(*ids).schema.add("lang", "string").add("confidence", "double").add("text_lang", "string")
    return placed.select(*columns).unionByName(alone.select(*columns)).mapInArrow(fuse, out)
