"""Operator 2: near-duplicates by BagMinHash over word shingles.

A document is the bag of its five-word shingles. Of each element with weight w, the weight axis is cut into the
levels [0,1), [1,2), [2,4), [4,8) ..; each level has a Poisson process of points (time, register, height), the same in
all documents that hold the element. A point counts if its height is under w, so a level over which w reaches only in
part is thinned. The least time in each register is the signature: two documents agree in a register with a probability
equal to the weighted Jaccard similarity of their bags. Points come in order of time, so an element is left as soon as
its next point is later than the last register of its document: few points are ever drawn.

Signatures are cut into bands, and texts that share a band are a bucket. Each text is compared exactly with the leader of
each of its buckets; that settles buckets whose texts are all alike, however large. Only buckets of three or more that still hold
texts of several classes are compared pair by pair, by an inverted list of shingles, in blocks of bounded size. Equal texts are one throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, cut, group_runs, grouped, joinable, mix64, scan_texts

_U = np.uint64
_MASK = (1 << 64) - 1


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_MEMO = _Memo()
hash_word = _MEMO.__getitem__


def shingles(words: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of documents laid out in a row, with the document of each; fewer words than ``size`` are one shingle."""
    lengths = np.diff(starts)
    value = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = starts[1:][doc] - np.arange(len(words))  # words from here to the end of the document
    for k in range(size):
        value = mix64(value * _U(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(words)], _U(k)) + _U(k + 1))
    keep = (left >= size) | ((lengths[doc] < size) & (left == lengths[doc]))
    return value[keep], doc[keep]


def bags(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with their counts, in that order."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return value[at], doc[at], np.diff(np.append(at, len(value)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(value: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash signatures (documents x registers) of bags of counts; documents without elements get infinity."""
    sig = np.full(n_docs * registers, np.inf)
    # One process for each level that the weight reaches: level 0 is [0,1), level j is [2^(j-1), 2^j).
    top = int(weight.max(initial=0))
    levels = [(value, doc, np.ones(len(value)), np.zeros(len(value)), np.ones(len(value)), 0)]
    low, j = 1, 1
    while low < top:
        part = np.flatnonzero(weight > low)
        levels.append((value[part], doc[part], np.full(len(part), float(low)), np.full(len(part), float(low)), weight[part].astype(float), j))
        low, j = low * 2, j + 1
    seed = np.concatenate([mix64(v + _U(j * 0xD6E8FEB86659FD93 & _MASK)) for v, *_, j in levels])
    doc, rate, floor, weight = (np.concatenate([x[k] for x in levels]) for k in (1, 2, 3, 4))
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        draw = mix64(seed + _U(step * 0x9E3779B97F4A7C15 & _MASK))
        time = time - np.log(_uniform(draw)) / rate
        if step > 1:  # points later than all registers change nothing, and so do those after them
            last = sig.reshape(n_docs, registers).max(axis=1)
            live = time < last[doc]
            seed, doc, rate, floor, weight, time, draw = (x[live] for x in (seed, doc, rate, floor, weight, time, draw))
        more = mix64(draw ^ _U(0xA0761D6478BD642F))
        inside = floor + rate * _uniform(mix64(more)) < weight
        register = ((more >> _U(32)) * _U(registers)) >> _U(32)
        np.minimum.at(sig, (doc * registers + register.astype(np.int64))[inside], time[inside])
    return sig.reshape(n_docs, registers)


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    split = [t.lower().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    words = np.fromiter((hash_word(w) for s in split for w in s), dtype=np.uint64, count=int(starts[-1]))
    return words, starts, split


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): a hash that tells the texts of one doc_id apart; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """Rows (doc_id, text_key, len, text_hash, bands): the text's bytes, a hash of its word sequence, and one hash for each band of the signature."""

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        texts = columns[-1]
        words, starts, split = _laid_out(texts.to_pylist())
        same = [hashlib.blake2b("\x00".join(s).encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in split]
        sig = signatures(*bags(*shingles(words, starts, size)), len(split), bands * rows).view(np.uint64).reshape(len(split), bands, rows)
        keys = np.zeros((len(split), bands), dtype=np.uint64)
        for r in range(rows):
            keys = mix64(keys * _U(0x9E3779B97F4A7C15) + sig[:, :, r])
        keys = mix64(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(split) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*columns[:2], pc.binary_length(texts).cast(pa.int64()), pa.array(same, pa.binary()), lists], names=["doc_id", "text_key", "len", "text_hash", "bands"])

    return scan_texts(_keyed(docs), fn, "doc_id long, text_key long, len long, text_hash binary, bands array<long>", columns=("doc_id", "text_key", "text"), max_bytes=2 << 20)


def like_leaders(texts: list[str], leader: np.ndarray, threshold: float, size: int) -> np.ndarray:
    """For each text, whether its similarity to the text at ``leader`` (its own place: not compared) is ``threshold`` or more."""
    value, doc, weight = bags(*shingles(*_laid_out(texts)[:2], size))
    n = len(texts)
    total = np.bincount(doc, weights=weight, minlength=n)
    leads = np.zeros(n, dtype=bool)
    leads[leader] = True
    marked = lambda who, v: mix64(v ^ mix64(who.astype(np.uint64) + _U(1)))
    theirs, mine = leads[doc], leader[doc] != doc
    index = marked(doc[theirs], value[theirs])
    order = np.argsort(index)
    index, held = np.append(index[order], _U(_MASK)), np.append(weight[theirs][order], 0)
    want = marked(leader[doc[mine]], value[mine])
    at = np.searchsorted(index[:-1], want)
    shared = np.bincount(doc[mine], weights=np.where(index[at] == want, np.minimum(held[at], weight[mine]), 0), minlength=n)
    # J = s / (a + b - s) >= t, with slack for rounding only
    return (leader != np.arange(n)) & (shared > 0) & (shared * (1 + threshold) >= threshold * (total + total[leader]) - 1e-9)


def similar_pairs(texts: list[str], labels: list[int], threshold: float, size: int) -> list[tuple[int, int]]:
    """Pairs of texts whose bags have a weighted Jaccard similarity of ``threshold`` or more; of texts already joined, by a pair or by their label, none.

    Each text is compared with all later ones at once: its shingles' inverted lists give the shared weight.
    """
    words, starts, _ = _laid_out(texts)
    value, doc, weight = bags(*shingles(words, starts, size))
    n = len(texts)
    total = np.bincount(doc, weights=weight, minlength=n)
    ends = np.searchsorted(doc, np.arange(n + 1))
    by_value = np.lexsort((doc, value))
    sorted_value, list_doc, list_weight = value[by_value], doc[by_value], weight[by_value]
    stop = np.searchsorted(sorted_value, value, "right")
    place = np.empty(len(value), dtype=np.int64)
    place[by_value] = np.arange(len(value))
    root = np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(n - 1):
        mine = slice(ends[i], ends[i + 1])
        begin, length = place[mine] + 1, stop[mine] - place[mine] - 1  # later documents only
        if not length.any():
            continue
        at = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
        own = np.repeat(weight[mine], length)
        apart = root[list_doc[at]] != root[i]
        at, own = at[apart], own[apart]
        shared = np.bincount(list_doc[at], weights=np.minimum(list_weight[at], own), minlength=n)
        near = np.flatnonzero(shared * (1 + threshold) >= threshold * (total[i] + total) - 1e-9)
        near = near[(near > i) & (shared[near] > 0)]
        for k in near:
            if root[k] != root[i]:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def _classified(docs: DataFrame, threshold: float, bands: int, rows: int, size: int, block_bytes: int, block_rows: int) -> DataFrame:
    """Rows (doc_id, text_key, class_id, text_rep, keep), one for each row of ``docs``; ``keep`` holds for the rows of one id and one text of each class."""
    sketched = cut(sketches(docs, bands, rows, size), "sketches")
    # Null ids come last in the order of rows; a text's first row stands for it.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    texts = sketched.groupBy("text_hash").agg(F.min(row).alias("row"), F.max("len").alias("len"), F.first("bands").alias("bands"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    # Bands: the least text of each bucket leads it. No step gathers a bucket.
    keys = texts.select("node", F.explode("bands").alias("key"))
    leaders = cut(keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    linked = keys.join(leaders, "key").where("node != leader")
    links = cut(linked.select("node", "leader").distinct(), "links")
    # The texts of all buckets, one row each.
    met = joinable(links.select("node").union(links.select(F.col("leader").alias("node"))).distinct().join(texts.select("node", "row", "len"), "node").select("node", "len", F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("k")), "met")
    body = _keyed(docs).join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k")))
    body = cut(body.select("node", "len", "text").dropDuplicates(["node"]), "members")
    # Each text against its leaders. The texts of one leader are dealt out by their bytes, each part with the leader's text.
    fan = links.join(body.select("node", "len"), "node").groupBy("leader").agg(F.greatest(F.ceil(F.sum("len") / F.lit(1e6)), F.lit(1)).cast("int").alias("parts"))
    fan = cut(fan, "fan")
    followers = links.join(fan, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    lead = fan.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    dealt = followers.union(lead).join(body.select("node", "text"), "node").select(F.xxhash64("leader", "part").alias("deal"), "leader", "node", "text")

    def compare_leaders(table: pa.Table) -> Iterator[pa.RecordBatch]:
        leader, node = table.column("leader").to_numpy(), table.column("node").to_numpy()
        own = {x: k for k, x in enumerate(node.tolist()) if leader[k] == x}
        alike = like_leaders(table.column("text").to_pylist(), np.array([own[x] for x in leader.tolist()]), threshold, size)
        yield pa.RecordBatch.from_arrays([pa.array(node[alike]), pa.array(leader[alike])], names=["a", "b"])

    edges = cut(group_runs(dealt, "deal", compare_leaders, "a long, b long", rows=4000, most_bytes=4 << 20), "edges")
    # What is left: buckets of three or more with texts of several classes.
    known = components(edges).select(F.col("id").alias("node"), "root")
    labelled = keys.join(leaders.where("n > 2"), "key").join(known, "node", "left").select("key", "node", "leader", F.coalesce("root", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    left = cut(labelled.join(mixed, "key").select("node", "leader", "label").distinct(), "left")
    clusters = components(left.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
    members = clusters.withColumnRenamed("id", "node").join(left.select("node", "label").distinct(), "node").join(body.select("node", "len"), "node")
    members = cut(members, "clusters")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("len") / F.lit(float(block_bytes))), F.ceil(F.count("*") / F.lit(float(block_rows))), F.lit(1)).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = placed.select(
        "root", "node", "label",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))).alias("p"),
    ).select("root", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "node", "label")
    pairs = pairs.join(body.select("node", "text"), "node").select("root", "x", "y", "node", "label", "text")

    def compare_all(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_pylist()
        found = similar_pairs(table.column("text").to_pylist(), table.column("label").to_pylist(), threshold, size)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[k] for _, k in found], pa.int64())], names=["a", "b"])

    more = grouped(pairs, ["root", "x", "y"], compare_all, "a long, b long", presorted=["node"])
    classes = components(edges.union(more)).withColumnRenamed("id", "node").join(texts.select("node", "row", "text_hash"), "node")
    # The text of a class with the least row stays.
    firsts = classes.groupBy("root").agg(F.min(F.struct("row", "text_hash", "node")).alias("first"))
    classes = classes.select("node", "root").join(firsts, "root").select("node", F.col("first.row.doc_id").alias("class_id"), F.col("first.node").alias("kept"), F.lit(True).alias("in_class"))
    of_text = texts.select("text_hash", "row", "node").join(classes, "node", "left").select(
        "text_hash", "row", F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("row.doc_id")).alias("class_id"), F.coalesce(F.col("kept") == F.col("node"), F.lit(True)).alias("stays")
    )
    return sketched.select("doc_id", "text_key", "text_hash").join(of_text, "text_hash").select(
        "doc_id", "text_key", "class_id", F.col("row.doc_id").alias("text_rep"), (F.col("stays") & row.eqNullSafe(F.col("row"))).alias("keep")
    )


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 30, rows: int = 6, size: int = 5, block_bytes: int = 4 << 20, block_rows: int = 2000) -> DataFrame:
    """Rows (doc_id, class_id, text_rep): the least doc_id of the document's near-duplicate class, and of its equal texts.

    Words are lower-cased and cut at white space; a class is a connected set of texts linked by a similarity of
    ``threshold`` or more. With 30 bands of 6 a pair at 0.8 is met with probability 0.9999, one at 0.3 with 0.02.
    Each input row gives a row. Null and empty texts, and texts without words, are equal texts of one class. Rows with a
    null doc_id are in the class of their text; a class of such rows only has a null class_id. A doc_id with several texts is in
    several classes. Texts shorter than ``size`` words are one shingle. Extra columns are ignored, an empty table gives no rows.
    """
    return _classified(docs, threshold, bands, rows, size, block_bytes, block_rows).select("doc_id", "class_id", "text_rep")


def keep_one(docs: DataFrame, threshold: float = 0.8, bands: int = 30, rows: int = 6, size: int = 5, block_bytes: int = 4 << 20, block_rows: int = 2000) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (null ids last), of its texts the least by a hash.

    The decision is by row: texts that share a doc_id are apart, and of rows equal in id and text one stays.
    """
    rows_of = _classified(docs, threshold, bands, rows, size, block_bytes, block_rows)
    by_row = cut(rows_of.groupBy("doc_id", "text_key").agg(F.max("keep").alias("keep"), F.count("*").alias("n")).where("not keep or n > 1"), "rows")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__text_key", F.xxhash64(text, F.octet_length(text)))

    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__k"))
    named = by_row.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"), "keep")
    repeated = named.where("keep")
    if repeated.limit(1).count():
        once = keyed.join(joinable(repeated.drop("keep"), "repeated"), at, "left_semi").dropDuplicates(["doc_id", "__text_key"])
        others = keyed.join(joinable(named.drop("keep"), "settled"), at, "left_anti")
        return others.union(once).select(docs.columns)
    return keyed.join(joinable(named.drop("keep"), "lost"), at, "left_anti").select(docs.columns)
