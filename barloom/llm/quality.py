"""Operator 7: quality by hierarchical empirical Bayes.

A document classifier gives the evidence of a text. The evidence is summed by path and by host; the rate of good
documents of a host is shrunk toward the global rate, that of a path toward its host's, each by as many pseudo-documents as
the spread of the rates at that level asks for (method of moments). The posterior of a document is its own evidence with
the prior of its path, from which the document itself is left out, so that no evidence counts twice.

A good document is one labelled as of quality and not as toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, joinable, scan_texts

_WORD = re.compile(r"\w+")
_SIGNS = "!#$%&*|@="
N_SHAPES = 9


def shape_features(text: str, words: list[str]) -> list[float]:
    """What a text looks like: shares of capitals, signs, words that end in a sign, repeated lines, repeated words, words said twice in a row."""
    n = max(1, len(text))
    letters = max(1, sum(map(len, words)))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    lines = [x for x in text.split("\n") if x.strip()]
    signs = sum(text.count(c) for c in _SIGNS)
    tailed = sum(w[-1] in _SIGNS for w in words)
    return [
        1.0,
        upper / max(1, len(words)),
        min(1.0, 8 * signs / n),
        tailed / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(words)) / max(1, len(words)),
        min(1.0, len(words) / 20),
        min(2.0, letters / max(1, len(words)) / 8),
        min(1.0, 4 * sum(map(str.__eq__, words, words[1:])) / max(1, len(words))),
    ]


class Classifier:
    """Logistic regression over shapes and the presence of chosen words."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def columns(self, text: str) -> tuple[list[float], list[int]]:
        words = text.split()
        get = self.vocabulary.get
        found = {get(w) for w in {p for w in set(words) for p in _parts(w)}}
        found.discard(None)
        return shape_features(text, words), [N_SHAPES + k for k in found]

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            shapes, words = self.columns(t)
            out[k] = self.weights[:N_SHAPES] @ shapes + self.weights[words].sum()
        return out


class _Parts(dict):
    """The words in a raw word, and the first five letters of longer ones (marked): words with one stem tell the same."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 50_000:
            self.clear()
        whole = _WORD.findall(word.lower())
        value = self[word] = tuple(dict.fromkeys([*whole, *[w[:5] + "*" for w in whole if len(w) > 5]]))
        return value


_parts = _Parts().__getitem__


def words_of(text: str) -> set[str]:
    return {p for w in set(text.split()) for p in _parts(w)}


def telling_words(labelled: DataFrame, n_words: int) -> list[str]:
    """The words whose presence tells texts of low quality, or toxic ones, from others most against chance (rows text, low, toxic), the most telling first.

    The two kinds are told apart by different words, so each has its own measure; a word counts by the larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
        for batch in batches:
            for text, *kinds in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = words_of(text)
                for counts in (held[0], *(c for c, kind in zip(held[1:], kinds) if kind)):
                    counts.update(words)
        words = list(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]], names=["word", "n", "low", "toxic"])

    whole = labelled.agg(F.count("*").alias("n"), F.count_if("low").alias("low"), F.count_if("toxic").alias("toxic")).first()
    counts = labelled.select("text", "low", "toxic").mapInArrow(run, "word string, n long, low long, toxic long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")]).where("n >= 5")

    def against_chance(kind: str) -> Column:
        a, b = max(1, whole["n"] - whole[kind]), max(1, whole[kind])
        p = F.col("n") / F.lit(a + b)
        return F.abs((F.col("n") - F.col(kind)) / a - F.col(kind) / b) / F.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)

    z = F.greatest(against_chance("low"), against_chance("toxic"))
    return [r.word for r in counts.select("word", z.alias("z")).where("z > 5").orderBy(F.desc("z"), "word").limit(n_words).collect()]


def fit(shapes: np.ndarray, words: list[list[int]], good: np.ndarray, vocabulary: list[str], passes: int = 1000, decay: float = 3e-4) -> Classifier:
    """Weights by Newton-scaled gradient steps, from the shapes and the numbers of the chosen words of the labelled texts."""
    model = Classifier({w: k for k, w in enumerate(vocabulary)}, np.zeros(N_SHAPES + len(vocabulary)))
    x = np.zeros((len(good), N_SHAPES + len(vocabulary)))
    x[:, :N_SHAPES] = shapes
    for k, found in enumerate(words):
        x[k, found] = 1
    w = model.weights
    scale = 0.25 * (x * x).mean(axis=0) * x.astype(bool).sum(axis=1).mean() + decay
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += (x.T @ (good - p) / len(good) - decay * w) / scale
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, n_words: int = 400) -> Classifier:
    """The classifier, fitted on at most ``sample`` labelled documents, the least by a hash of doc_id, whole texts.

    Rows without a quality label are left out; a missing toxic label counts as not toxic; of texts that share a doc_id
    the least by a hash is taken. Texts stay on the executors: the driver gets the chosen words and, for each labelled
    document, its shapes and the chosen words it has. Without labels of both sides the classifier has no evidence: all its
    logits are zero.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"), F.max(F.coalesce("toxic", F.lit(0))).alias("__t"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("__q") != 1).alias("low"), (F.col("__t") != 0).alias("toxic"))  # at most ``sample`` labels
    rows = cut(rows.groupBy("doc_id", "low", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    vocabulary = telling_words(rows, n_words)
    blank = Classifier({w: k for k, w in enumerate(vocabulary)}, np.zeros(N_SHAPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blank.columns(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc_id", "good", "shapes", "words"])

    seen = rows.select("doc_id", (~F.col("low") & ~F.col("toxic")).alias("good"), "text").mapInArrow(run, "doc_id long, good boolean, shapes array<double>, words array<int>").toArrow().sort_by("doc_id")
    is_good = np.array(seen.column("good").to_pylist(), dtype=bool)
    if is_good.all() or not is_good.any():
        return Classifier({}, np.zeros(N_SHAPES))
    return fit(np.array(seen.column("shapes").to_pylist()), seen.column("words").to_pylist(), is_good, vocabulary)


def scored(docs: DataFrame, model: Classifier, extra: tuple[str, ...] = ()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        logit = shared.value.logits(columns[-1].to_pylist())
        yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(logit)], names=[*("doc_id", "host", "path", *extra), "logit"])

    return scan_texts(docs, fn, "doc_id long, host string, path string, " + "".join(f"{c} {kinds[c]}, " for c in extra) + "logit double", columns=("doc_id", "host", "path", *extra, "text"))


_ODDS = lambda p: F.ln(p / (1 - p))
_INSIDE = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))


def sites(evidence: DataFrame) -> DataFrame:
    """Rows (host, path, n, s, hn, hs, total_n, total_s, k_host, k_path, prior): documents and good ones, by evidence, of each path, its host and all.

    k_host and k_path are the pseudo-documents by which hosts shrink toward all and paths toward their host; ``prior`` is
    the path's shrunk rate.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    paths = cut(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s")).first()
    base = min(max(total["s"] / max(1, total["n"]), 1e-6), 1 - 1e-6)

    def strength(level: DataFrame, mean) -> float:
        """Pseudo-documents: within-site noise over the spread of the sites' rates beyond that noise."""
        got = level.agg(
            F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, F.lit(2))).alias("spread"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")
        ).first()
        noise = base * (1 - base)
        room = got["n"] - got["nn"] / got["n"] if got["n"] else 0
        between = (got["spread"] - noise * (got["k"] - 1)) / room if room > 0 else 0.0
        return min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6

    k_host = strength(hosts, F.lit(base))
    host_rate = (F.col("hs") + k_host * base) / (F.col("hn") + k_host)
    shrunk = hosts.select(F.col("host").alias("__h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    with_host = paths.join(shrunk, F.col("host").eqNullSafe(F.col("__h"))).drop("__h")
    k_path = strength(with_host, host_rate)
    return with_host.select(
        "*", F.lit(total["n"]).cast("long").alias("total_n"), F.lit(float(total["s"])).alias("total_s"), F.lit(float(k_host)).alias("k_host"), F.lit(float(k_path)).alias("k_path"),
        ((F.col("s") + k_path * host_rate) / (F.col("n") + k_path)).alias("prior"),
    )


def _judged(rows: DataFrame, host, path, logit, cut_at: float, out: tuple[str, str, str]) -> DataFrame:
    """``rows`` with (prior, posterior, keep) under the names of ``out``: the prior of the document's path without the document."""
    site = joinable(sites(rows.select(host.alias("host"), path.alias("path"), logit.alias("logit"))), "sites")
    site = site.select(F.struct("*").alias("__site"))
    at = lambda c: F.col(f"__site.{c}")
    both = rows.join(site, host.eqNullSafe(at("host")) & path.eqNullSafe(at("path")))
    p = 1 / (1 + F.exp(-logit))
    base = _INSIDE(F.when(at("total_n") > 1, (at("total_s") - p) / (at("total_n") - 1)).otherwise(F.lit(0.5)))
    of_host = (at("hs") - p + at("k_host") * base) / (at("hn") - 1 + at("k_host"))
    prior = _INSIDE((at("s") - p + at("k_path") * of_host) / (at("n") - 1 + at("k_path")))
    posterior = 1 / (1 + F.exp(-(logit + _ODDS(F.col(out[0])) - _ODDS(base))))
    return both.withColumn(out[0], prior).withColumn(out[1], posterior).withColumn(out[2], F.col(out[1]) >= cut_at).drop("__site")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", cut_at: float = 0.5, sample: int = 4000) -> DataFrame:
    """Rows (doc_id, host, path, evidence, prior, posterior, keep): each document's own log-odds, its path's prior without it, and the decision.

    ``host`` and ``path`` name the columns of the two levels; null values are a site of their own. Null or empty texts are
    scored as texts without words. Null ids and repeated rows pass row by row, an empty table gives no rows, extra columns
    are ignored. Ties at ``cut_at`` are kept.
    """
    body = docs.select("doc_id", F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), "text")
    evidence = cut(scored(body, train(body, labels, sample)), "evidence")
    return _judged(evidence, F.col("host"), F.col("path"), F.col("logit"), cut_at, ("prior", "posterior", "keep")).select("doc_id", "host", "path", F.col("logit").alias("evidence"), "prior", "posterior", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", cut_at: float = 0.5, sample: int = 4000) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects, those with a null doc_id too.

    Each text is classified once; rows are written with their evidence, and the figures of the sites are joined to them.
    """
    site = {"host": F.col(f"`{host}`").cast("string"), "path": F.col(f"`{path}`").cast("string")}
    model = train(docs.select("doc_id", *[c.alias(n) for n, c in site.items()], "text"), labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.logits(texts.tolist()))

    rows = cut(docs.withColumn("__logit", evidence(F.coalesce("text", F.lit("")))), "rows")
    return _judged(rows, site["host"], site["path"], F.col("__logit"), cut_at, ("__prior", "__posterior", "__keep")).where("__keep").select(docs.columns)
