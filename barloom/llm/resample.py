"""Operator 12: importance resampling towards a target distribution, by hashed n-grams of words.

The words of a run of texts are laid in a trie of depth three: a node is a word after its parent's words, and holds how
often its path occurs and the CRC-32 of its path, which follows from the parent's state and the word's own CRC. The counts
of the nodes, added up by bucket, are all that leaves a task. Once the totals of the corpus and of the target are known, each
bucket has a gain; a node's gain is added to its parent's, so that a text's weight is one look-up for each of its words, at the
deepest node that the path from there reaches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, joinable, scan_texts, slices
from barloom.llm.crc import Joiner

DEPTH = 3

#: Bytes as they are read: A-Z as a-z, and all that is no part of a word (00-2F, 3A-60, 7B-7F) as a space.
READ_AS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces_of(text: bytes, most: int) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in pieces of about ``most`` bytes, each but the first led by the last two words of the one before; and whether it is the last."""
    start, lead = 0, []
    while True:
        end = start + most
        if end < len(text):
            while end < len(text) and READ_AS[text[end]] != 32:
                end += 1
        words = lead + text[start:end].translate(READ_AS).split()
        if end >= len(text):
            yield words, True
            return
        if len(words) >= DEPTH:
            yield words, False
            words = words[1 - DEPTH :]
        lead, start = words, end


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Trie:
    """The trie of some texts: for each depth the parents, CRC states and counts of its nodes, and the deepest node of each starting word."""

    def __init__(self, runs: list[tuple[int, list[bytes], bool]], joiner: Joiner) -> None:
        ids = _Ids()
        lengths = np.array([len(words) for _, words, _ in runs], dtype=np.int64)
        word = np.fromiter((ids[w] for _, words, _ in runs for w in words), dtype=np.int64, count=int(lengths.sum()))
        ends = np.repeat(np.cumsum(lengths), lengths)
        left = ends - np.arange(len(word))
        # The last words of a piece that goes on are starts in the next piece.
        goes_on = np.repeat(np.array([not last for _, _, last in runs], dtype=bool), lengths)
        start = ~(goes_on & (left < DEPTH))
        self.owner = np.repeat(np.array([doc for doc, _, _ in runs], dtype=np.int64), lengths)[start]
        self.reach = np.minimum(left[start], DEPTH)
        own = np.array([zlib.crc32(w) for w in ids], dtype=np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in ids], dtype=np.uint32)
        size = np.array([len(w) + 1 for w in ids], dtype=np.int64)
        self.parent, self.crc, self.count = [None], [own], [np.bincount(word[start], minlength=len(ids))]
        self.nodes = [word[start]]
        at = np.flatnonzero(start)
        for depth in range(1, DEPTH):
            there = np.flatnonzero(self.reach > depth)
            path = self.nodes[-1][there] if depth == 1 else self.nodes[-1][np.searchsorted(self.starts, there)]
            key, node, count = np.unique(path * len(ids) + word[at[there] + depth], return_inverse=True, return_counts=True)
            parent, last = key // max(len(ids), 1), key % max(len(ids), 1)
            self.parent.append(parent)
            self.crc.append(joiner.join(self.crc[-1][parent], spaced[last], size[last]))
            self.count.append(count)
            self.nodes.append(node)
            self.starts = there

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        for crc, count in zip(self.crc, self.count):
            np.add.at(out, crc % np.uint32(buckets), count)
        return out

    def weights(self, gain: np.ndarray, n_docs: int) -> np.ndarray:
        """The gains of all features of each document, added up: a node's gain with those of the nodes above it, at the deepest node of each start."""
        along = [gain[self.crc[0] % np.uint32(len(gain))]]
        for parent, crc in zip(self.parent[1:], self.crc[1:]):
            along.append(along[-1][parent] + gain[crc % np.uint32(len(gain))])
        total = np.zeros(n_docs, dtype=np.int64)
        value = along[0][self.nodes[0]]
        there = np.arange(len(value))
        for depth in range(1, DEPTH):
            there = np.flatnonzero(self.reach > depth)
            value[there] = along[depth][self.nodes[depth]]
        np.add.at(total, self.owner, value)
        return total


def _tries(texts: list[bytes], joiner: Joiner, most: int) -> Iterator[Trie]:
    held, size = [], 0
    for doc, text in enumerate(texts):
        for words, last in pieces_of(text, most):
            if words:
                held.append((doc, words, last))
            size += min(len(text), most)
            if size >= most:
                if held:
                    yield Trie(held, joiner)
                held, size = [], 0
    if held:
        yield Trie(held, joiner)


def bucket_totals(texts: DataFrame, buckets: int = 10_000, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows (bucket, n): how many features of the column ``text`` fall in each bucket; buckets without any have no row. A task gives one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, total = Joiner(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, most_bytes):
                for trie in _tries(part.column(0).cast(pa.large_binary()).to_pylist(), joiner, most_bytes):
                    total += trie.totals(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket, in thousandths: the log of its smoothed share in the target over that in the corpus. ``buckets`` numbers of each come to the driver."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for table, out in ((corpus, s), (target, t)):
        for row in table.collect():  # one row a bucket
            out[row["bucket"]] = row["n"]
    whole_s, whole_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * whole_s) / float((int(a) + 1) * whole_t))) for a, b in zip(s, t)], dtype=np.int64)


def weigh(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, text_key, n_words, n_features, weight, score, rank), one for each row of ``docs``.

    ``weight`` is the sum of the gains of a text's features, ``score`` adds Gumbel noise drawn from ``seed`` and doc_id, so that the
    highest scores are a sample without replacement by weight. Of the rows with ``least_words`` words or more, ``percent`` in a
    hundred (rounded down) get a rank, by falling score, then by doc_id (null last), then by a hash of the text.

    Null and empty texts have no words, no features and weight 0. A null doc_id reads as an empty one in the noise. Rows equal in
    all of it take ranks in any order. Extra columns are ignored; an empty table gives no rows. An empty target leaves smoothed shares.
    """
    gain = gains(bucket_totals(docs, buckets, most_bytes), bucket_totals(target, buckets, most_bytes), buckets)

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        texts = columns[-1].cast(pa.large_binary()).to_pylist()
        n = len(texts)
        words, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
        for trie in _tries(texts, Joiner(), most_bytes):
            words += np.bincount(trie.owner, minlength=n)
            np.add.at(features, trie.owner, trie.reach)
            weight += trie.weights(gain, n)
        yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "text_key", "n_words", "n_features", "weight"])

    scored = scan_texts(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), fn, "doc_id long, text_key long, n_words long, n_features long, weight long", columns=("doc_id", "text_key", "text"), max_bytes=most_bytes)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(scored.withColumn("score", F.col("weight") + noise), "scored")
    # Rows in the order of ranks over ranges; a row's rank is its place in its range after the rows of earlier ranges.
    order = [(F.col("n_words") >= least_words).desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key").asc()]
    ranged = cut(scored.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.count_if(F.col("n_words") >= least_words).alias("long_enough"))
    starts = sizes.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("start"), (F.sum("long_enough").over(Window.partitionBy()) * percent / F.lit(100)).cast("long").alias("drawn"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    placed = ranged.join(F.broadcast(starts), "range").withColumn("rank", place)
    return placed.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).select("doc_id", "text_key", "n_words", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, **options) -> DataFrame:
    """The drawn rows of ``docs``, whole, with ``rank_in_sample``: ``weigh`` tells the options and what holds for odd rows. Of rows equal in id and text one stands for all."""
    drawn = weigh(docs, target, percent, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("rank").alias("rank_in_sample"))
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    return keyed.dropDuplicates(["doc_id", "__text_key"]).join(joinable(drawn, "drawn"), at).select(*[F.col(f"`{c}`") for c in docs.columns], "rank_in_sample")
