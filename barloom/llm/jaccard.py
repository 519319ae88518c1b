"""Operator 11: exact Jaccard join of shingle sets, by prefixes of token combinations.

A document is the set of its four-word shingles. Shingles have one order for all documents, rare ones first, by a table of bucket
counts. Rare shingles are tokens of class 1, frequent ones of class 2, the most frequent of class 3; those of a class are dealt over
subclasses by a hash. A set of n shingles that is linked to another misses at most ``n - o`` of them, o the least overlap. Its prefix is
extended until the sum of ``max(0, c - (k - 1))``, over the subclasses of class k with c shingles of the prefix, is over ``n - o``:
then in some subclass k shingles are in both prefixes. So rare shingles are indexed singly, the others as pairs or triples
of one subclass, and every linked pair meets under a key.

Subclasses are as many as suits the size of the set: sets are in brackets by powers of two, and a set that can be linked to some of
the next bracket is indexed there too. Sets of five shingles or fewer are linked to equal sets only, and equal sets are one throughout.

Sets that meet are verified, in groups of like size: each against the leaders of its groups, sets that meet most others; then, where sets of
several components are left in a group, pair by pair in blocks of bounded size. Only pairs that their bitmaps leave possible are verified on the shingles. What is far from a leader can't be linked to what is close to it, as the distance 1 - J is a metric.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.bagminhash import shingles
from barloom.llm.common import components, cut, forget, group_runs, joinable, mix64, scan_texts, slices

_U = np.uint64
_SEGMENT = 4096


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_MEMO = _Memo()


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as (value, document), in order of both. Only A-Z are lower-cased; words end at ASCII white space."""
    split = [t.lower().split() for t in texts.cast(pa.large_binary()).to_pylist()]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    word = _MEMO.__getitem__
    words = np.fromiter((word(w) for s in split for w in s), dtype=np.uint64, count=int(lengths.sum()))
    value, doc = shingles(words, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), size)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def shingle_levels(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """For each of 2 ** ``bits`` buckets of shingles, the power of two of its count beyond the mean of all buckets. One byte a bucket comes to the driver.

    Each task counts its texts' shingles by bucket and gives segments of counts, which are added up as they stream by.
    """
    n = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, 2 << 20):
                total += np.bincount((sets_of(part.column(0), size)[0] >> _U(64 - bits)).astype(np.int64), minlength=n)
        for k in range(0, n, _SEGMENT):
            some = total[k : k + _SEGMENT]
            if some.any():
                narrow = some.astype(np.uint16) if some.max() < 1 << 16 else some
                yield pa.RecordBatch.from_arrays([pa.array([k // _SEGMENT], pa.int32()), pa.array([narrow.tobytes()], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width = min(_SEGMENT, n)
                seen = np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * width else np.int64)
                total[k] = total.get(k, 0) + seen.astype(np.int64)
        for k, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["segment", "counts"])

    form = "segment int, counts binary"
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = np.zeros(n, dtype=np.int64)
    for row in texts.mapInArrow(count, form).repartition("segment").mapInArrow(add, form).collect():  # 2 ** bits counts in all
        counts[row["segment"] * _SEGMENT :][:_SEGMENT] = np.frombuffer(row["counts"], dtype=np.int64)
    mean = counts.mean()
    return np.log2(np.maximum(1, counts - mean - 4 * np.sqrt(mean))).astype(np.uint8)


def combinations(value: np.ndarray, doc: np.ndarray, levels: np.ndarray, rare: int, common: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of sets given as (value, doc) in order of both: (key, doc), distinct. ``rare`` and ``common`` are the last levels of classes 1 and 2."""
    n_docs = int(doc[-1]) + 1 if len(doc) else 0
    size = np.bincount(doc, minlength=n_docs)
    level = levels[(value >> _U(64 - int(np.log2(len(levels))))).astype(np.int64)]
    keys, owners = [], []
    own = np.frexp(size)[1].astype(np.int64) - 1
    for further in (0, 1):
        bracket = own + further
        here = size > 5
        if further:
            here &= 100 * size >= percent * (np.int64(1) << np.maximum(bracket, 0))
        rows = np.flatnonzero(here[doc])
        if not len(rows):
            continue
        rows = rows[np.lexsort((value[rows], level[rows], doc[rows]))]
        v, d, lv = value[rows], doc[rows], level[rows]
        k = np.where(lv <= rare, 1, np.where(lv <= common, 2, 3))
        parts = np.maximum(1, (np.int64(1) << bracket[d]) // 5)
        sub = (mix64(v) % parts.astype(np.uint64)).astype(np.int64)
        # A subclass is named by its class and number; the place of a shingle among those of its subclass tells whether it counts.
        group = np.lexsort((np.arange(len(v)), sub, k, d))
        gd, gk, gs = d[group], k[group], sub[group]
        first = np.ones(len(v), dtype=bool)
        first[1:] = (gd[1:] != gd[:-1]) | (gk[1:] != gk[:-1]) | ((gs[1:] != gs[:-1]) & (gk[1:] > 1))
        begin = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
        counts = np.empty(len(v), dtype=bool)
        counts[group] = np.arange(len(v)) - begin >= gk - 1
        # The prefix ends with the shingle that makes the sum large enough.
        least = -(-percent * size // 100)
        run = np.cumsum(counts)
        start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        base = np.repeat(run[start] - counts[start], np.diff(np.append(start, len(d))))
        inside = run - base - counts <= (size - least)[d]
        kept = inside[group]
        gv, gd, gk, gs = v[group][kept], gd[kept], gk[kept], gs[kept]
        one = gk == 1
        keys.append(mix64(gv[one] + _U(1)))
        owners.append(gd[one])
        for width in (2, 3):
            at = np.flatnonzero(gk == width)
            at = at[np.lexsort((gv[at], gs[at], gd[at]))]
            cv, cd, cs = gv[at], gd[at], gs[at]
            heads, code = np.arange(len(cv)), mix64(cv + _U(width))
            for key, owner in _joined(cv, cd, cs, heads, heads, code, width - 1):
                keys.append(key)
                owners.append(owner)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def _joined(value: np.ndarray, doc: np.ndarray, sub: np.ndarray, first: np.ndarray, last: np.ndarray, code: np.ndarray, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all combinations that begin as ``code`` says, ``last`` the place of the last member so far, with ``more`` later members of the same subclass."""
    if not more:
        yield code, doc[first]
        return
    step = 1
    while True:
        nxt = last + step
        there = nxt < len(value)
        nxt = np.minimum(nxt, max(len(value) - 1, 0))
        there &= (doc[nxt] == doc[first]) & (sub[nxt] == sub[first])
        first, last, code, nxt = first[there], last[there], code[there], nxt[there]
        if not len(first):
            return
        yield from _joined(value, doc, sub, first, nxt, mix64(code * _U(0x9E3779B97F4A7C15) + value[nxt]), more - 1)
        step += 1


def bitmaps(value: np.ndarray, doc: np.ndarray, count: int) -> list[bytes]:
    """For each document a bitmap of the low bits of its shingles, of a power of two of bits: more than twice its shingles, and at most four times as many."""
    bits = np.maximum(8, np.int64(2) << np.frexp(np.bincount(doc, minlength=count))[1].astype(np.int64))
    ends = np.cumsum(bits)
    flat = np.zeros(int(ends[-1]) if count else 0, dtype=bool)
    flat[(ends - bits)[doc] + (value & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flat, bitorder="little")
    return [packed[(e - b) // 8 : e // 8].tobytes() for e, b in zip(ends.tolist(), bits.tolist())]


def folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap brought down to ``size`` bytes: a bit is set where one that falls on it is."""
    return np.bitwise_or.reduce(np.frombuffer(raw, dtype=np.uint8).reshape(-1, size), axis=0)


def most_shared(own: np.ndarray, n: int | np.ndarray, others: np.ndarray, n_others: np.ndarray) -> np.ndarray:
    """A bound of the shingles that a set shares with each of ``others``: a bit that only one of two bitmaps has is a shingle that the other set lacks."""
    return np.minimum(n - np.bitwise_count(own & ~others).sum(axis=1, dtype=np.int64), n_others - np.bitwise_count(others & ~own).sum(axis=1, dtype=np.int64))


def plausible(maps: list[bytes], n: np.ndarray, labels: list[int], percent: int) -> np.ndarray:
    """Which sets may by their bitmaps be linked to one of another label."""
    out = np.zeros(len(maps), dtype=bool)
    if len(set(labels)) < 2:
        return out
    size = min(map(len, maps))
    table = np.stack([folded(m, size) for m in maps])
    label = np.unique(labels, return_inverse=True)[1]
    for i in range(len(maps)):
        shared = most_shared(table[i], n[i], table, n)
        able = (label != label[i]) & (100 * shared >= percent * (n[i] + n - shared))
        out[i] |= able.any()
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.octet_length(text)).alias("text_key"), text.alias("text"))


def signed(docs: DataFrame, levels: np.ndarray, rare: int, common: int, percent: int, size: int) -> DataFrame:
    """Rows (doc_id, text_key, n, set_hash, bits, keys), one for each row of ``docs``; a text without words has n = 0 and no hash."""
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        value, doc = sets_of(columns[-1], size)
        count = len(columns[-1])
        n = np.bincount(doc, minlength=count)
        ends = np.concatenate([[0], np.cumsum(n)])
        same = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1], ends[1:])]
        key, owner = combinations(value, doc, table.value, rare, common, percent)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(n.astype(np.int64)), pa.array(same, pa.binary()), pa.array(bitmaps(value, doc, count), pa.binary()), lists], names=["doc_id", "text_key", "n", "set_hash", "bits", "keys"])

    return scan_texts(_keyed(docs), fn, "doc_id long, text_key long, n long, set_hash binary, bits binary, keys array<long>", columns=("doc_id", "text_key", "text"), max_bytes=2 << 20)


def _shingles(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Rows (node, n, shingles) of the ``wanted`` nodes: the sorted hashes of their sets, written."""
    met = joinable(wanted.join(nodes.select("node", "row"), "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("k")), "met")

    def arrays(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        value, doc = sets_of(columns[-1], size)
        ends = np.searchsorted(doc, np.arange(len(columns[0]) + 1))
        raw = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([columns[0], pa.array(np.diff(ends).astype(np.int64)), pa.array(raw, pa.binary())], names=["node", "n", "shingles"])

    rows = _keyed(docs).join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k"))).select("node", "text")
    return cut(scan_texts(rows, arrays, "node long, n long, shingles binary", columns=("node", "text"), max_bytes=2 << 20).dropDuplicates(["node"]), "shingles")


def _flat(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(raw, dtype=np.uint64) for raw in column.to_pylist()]


def shared_with_leader(sets: list[np.ndarray], leader: np.ndarray) -> np.ndarray:
    """How many shingles each set shares with the one at ``leader``; sets are sorted."""
    out = np.zeros(len(sets), dtype=np.int64)
    order = np.argsort(leader, kind="stable")
    cuts = np.flatnonzero(np.append(True, leader[order][1:] != leader[order][:-1])) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        members = order[a:b]
        own = sets[leader[members[0]]]
        theirs = np.concatenate([sets[m] for m in members])
        at = np.minimum(np.searchsorted(own, theirs), max(len(own) - 1, 0))
        who = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
        out[members] = np.bincount(who[own[at] == theirs], minlength=len(members)) if len(own) else 0
    return out


def linked_pairs(sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of sets with ``100 * shared >= percent * union``; of sets already joined, by a pair or by their label, none."""
    n = len(sets)
    if len(set(labels)) == 1:
        return []
    total = np.array([len(s) for s in sets], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(total)])
    value = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), total)
    by_value = np.argsort(value, kind="stable")
    lists, ordered = doc[by_value], value[by_value]
    stop = np.searchsorted(ordered, value, "right")
    place = np.empty(len(value), dtype=np.int64)
    place[by_value] = np.arange(len(value))
    root = np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for i in range(n - 1):
        mine = slice(ends[i], ends[i + 1])
        begin, length = place[mine] + 1, stop[mine] - place[mine] - 1  # later sets only
        if not length.any():
            continue
        at = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
        other = lists[at]
        shared = np.bincount(other[root[other] != root[i]], minlength=n)
        near = np.flatnonzero((shared > 0) & (100 * shared >= percent * (total[i] + total - shared)))
        for k in near:
            if root[k] != root[i]:
                out.append((i, int(k)))
                root[root == root[k]] = root[i]
    return out


def join(docs: DataFrame, percent: int = 85, size: int = 4, rare: int = 7, common: int = 14, bits: int = 20, block_values: int = 1 << 20, block_rows: int = 2000) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``: the size of its set, and the least doc_id that links lead to.

    Two documents are linked when ``100 * shared >= percent * union`` of their sets of ``size``-word shingles (fewer words are one
    shingle). Null and empty texts and texts without words have no shingles and are linked with nothing: their component_id is their own
    doc_id. Rows with a null doc_id are linked like others; a component of such rows only has a null component_id. Repeated rows and
    rows that share a doc_id are judged by their own texts. Extra columns are ignored; an empty table gives no rows.

    ``rare`` and ``common`` are powers of two of how often a shingle occurs, up to which it is of class 1 and 2. ``percent`` has to be 85 or more,
    as the number of subclasses rests on it.
    """
    if percent < 85:
        raise ValueError("percent has to be 85 or more")
    every = cut(signed(docs, shingle_levels(docs, size, bits), rare, common, percent, size), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = every.where("n > 0").groupBy("set_hash").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = cut(every.select("doc_id", "n", "set_hash"), "rows")
    forget(every)  # keys and bitmaps are with the nodes
    # Keys under which several sets meet, by size: sets of one group may be linked by their sizes, or nearly so. Each group has a leader,
    # the set that meets most others under all its keys.
    keys = nodes.select("node", F.explode("keys").alias("key"))
    crowds = keys.groupBy("key").agg(F.count("*").alias("crowd"), F.min("node").alias("first"), F.max("node").alias("last")).where("crowd > 1")
    crowds = cut(crowds, "crowds")
    pairs = crowds.where("crowd = 2").select(F.explode(F.array("first", "last")).alias("node"), "key", "crowd")
    larger = keys.join(joinable(crowds.where("crowd > 2").select("key", "crowd"), "larger", 16 << 20), "key").select("node", "key", "crowd")
    meeting = cut(pairs.union(larger), "meeting")
    weight = meeting.groupBy("node").agg(F.sum("crowd").alias("weight"))
    band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))
    sized = meeting.join(weight.join(nodes.select("node", "n"), "node"), "node").select("key", "node", "n", "weight", F.explode(F.array(band, band + 1)).alias("band"))
    heavy = sized.groupBy("key", "band").agg(F.max(F.struct("weight", "node", "n")).alias("top"), F.count("*").alias("crowd")).where("crowd > 1")
    # From here on the sets of one leader and one band are a group, under whichever keys they meet.
    led = sized.join(heavy.select("key", "band", F.col("top.node").alias("leader"), F.col("top.n").alias("n_leader")), ["key", "band"]).where("node != leader")
    led = cut(led.groupBy("leader", "band", "node").agg(F.first("n").alias("n"), F.first("n_leader").alias("n_leader")).select(F.xxhash64("leader", "band").alias("group"), "node", "n", "leader", "n_leader"), "led")
    near_in_size = 100 * F.least("n", "n_leader") >= percent * F.greatest("n", "n_leader")
    links = cut(led.where(near_in_size).select("node", "leader").distinct(), "links")
    # Bitmaps tell most pairs that can't be linked; a pair's distance is at least what they leave.
    maps = nodes.select("node", "n", "bits")
    theirs = maps.select(F.col("node").alias("leader"), F.col("n").alias("n_leader"), F.col("bits").alias("bits_leader"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, leader, n, n_leader, bits, bits_leader = (batch.column(k).to_pylist() for k in range(6))
            most = []
            for k in range(len(node)):
                size = min(len(bits[k]), len(bits_leader[k]))
                most.append(int(most_shared(folded(bits[k], size), n[k], folded(bits_leader[k], size)[None], np.array([n_leader[k]]))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(most, pa.int64())], names=["node", "leader", "n", "n_leader", "most"])

    both = links.join(maps, "node").join(theirs, "leader").select("node", "leader", "n", "n_leader", "bits", "bits_leader")
    bounded = cut(both.mapInArrow(bound, "node long, leader long, n long, n_leader long, most long"), "bounded")
    links = bounded.where(100 * F.col("most") >= percent * (F.col("n") + F.col("n_leader") - F.col("most"))).select("node", "leader")
    body = _shingles(docs, nodes, links.select("node").union(links.select("leader")).distinct(), size)
    # Each set against its leaders. The sets of one leader are dealt out by their size, each part with the leader's own.
    fan = cut(links.join(body.select("node", "n"), "node").groupBy("leader").agg(F.greatest(F.ceil(F.sum("n") / F.lit(2e5)), F.lit(1)).cast("int").alias("parts")), "fan")
    followers = links.join(fan, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node")
    lead = fan.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"))
    dealt = followers.union(lead).join(body, "node").select(F.xxhash64("leader", "part").alias("deal"), "leader", "part", "node", "n", "shingles")

    def compare_leaders(table: pa.Table) -> Iterator[pa.RecordBatch]:
        leader, part, node, n = (table.column(c).to_numpy() for c in ("leader", "part", "node", "n"))
        own = {(x, p): k for k, (x, p) in enumerate(zip(node.tolist(), part.tolist())) if leader[k] == x}
        at = np.array([own[x] for x in zip(leader.tolist(), part.tolist())], dtype=np.int64)
        shared = shared_with_leader(_flat(table.column("shingles")), at)
        union = n + n[at] - shared
        other = node != leader
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (node, leader, shared, union)], names=["node", "leader", "shared", "joint"])

    judged = cut(group_runs(dealt, "deal", compare_leaders, "node long, leader long, shared long, joint long", rows=4000, most_bytes=8 << 20), "judged")
    edges = cut(judged.where(100 * F.col("shared") >= percent * F.col("joint")).select(F.col("node").alias("a"), F.col("leader").alias("b")), "edges")
    known = cut(components(edges).select(F.col("id").alias("node"), F.col("root").alias("label")), "known")
    # What is left in a group: sets beyond the leader's reach, and those within it that such a set may be linked to. 1 - J is a metric: sets
    # can be linked if their distances from the leader differ by at most that of a link. Sets too unlike in size to be compared have bounds only.
    reach = 1 - percent / 100 + 1e-9
    d = 1 - F.col("shared") / F.col("joint")
    by_bits = 1 - F.col("most") / (F.col("n") + F.col("n_leader") - F.col("most"))
    least = F.coalesce(d, by_bits, 1 - F.least("n", "n_leader") / F.greatest("n", "n_leader"))
    far = led.join(judged, ["node", "leader"], "left").join(bounded.select("node", "leader", "most"), ["node", "leader"], "left").withColumn("d", least).join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nearest = far.where(F.col("d") > reach).groupBy("group").agg(F.min("d").alias("nearest"))
    several = far.join(nearest, "group").where((F.col("d") > reach) | (F.col("d") + reach >= F.col("nearest"))).select("group", "node", "n", "label")
    # Groups of one label are settled; of groups with the same sets one stands for all.
    mixed = several.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("same"), F.count("*").alias("rows"), F.sum("n").alias("values")).where("x != y")
    parts = F.greatest(F.ceil(F.col("values") / F.lit(float(block_values))), F.ceil(F.col("rows") / F.lit(float(block_rows))), F.lit(1)).cast("int")
    mixed = mixed.groupBy("same", "rows").agg(F.min_by(F.struct("group", "values"), "group").alias("g")).select("g.group", "g.values", "rows").select("group", parts.alias("blocks"))
    placed = cut(several.join(mixed, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "left")
    pairs = placed.select(
        "group", "node", "label",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))).alias("p"),
    ).select(F.xxhash64("group", "p").alias("deal"), "node", "label")

    def runs(table: pa.Table) -> Iterator[slice]:
        deal = table.column("deal").to_numpy()
        cuts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1])).tolist() if len(deal) else []
        yield from (slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(deal)]))

    def may_link(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bits, n, label = table.column("bits").to_pylist(), table.column("n").to_numpy(), table.column("label").to_pylist()
        able = np.concatenate([plausible(bits[r], n[r], label[r], percent) for r in runs(table)] or [np.zeros(0, bool)])
        yield from table.select(["deal", "node", "label"]).filter(pa.array(able)).combine_chunks().to_batches()

    open_pairs = cut(group_runs(pairs.join(maps, "node"), "deal", may_link, "deal long, node long, label long", rows=20_000, most_bytes=16 << 20), "open")
    rest = _shingles(docs, nodes, open_pairs.select("node").distinct(), size)
    open_pairs = open_pairs.join(rest.select("node", "shingles"), "node")

    def compare_all(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, sets = table.column("node").to_pylist(), table.column("label").to_pylist(), _flat(table.column("shingles"))
        found = [(node[r][i], node[r][k]) for r in runs(table) for i, k in linked_pairs(sets[r], label[r], percent)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    more = group_runs(open_pairs, "deal", compare_all, "a long, b long", rows=4000, most_bytes=16 << 20)
    joined = components(edges.union(more)).select(F.col("id").alias("node"), "root")
    whole = nodes.select("node", "set_hash", "row").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = whole.groupBy("root").agg(F.min("row").alias("first"))
    of_set = whole.join(firsts, "root").select("set_hash", F.col("first.doc_id").alias("component_id"), F.lit(True).alias("has_set"))
    out = rows.select("doc_id", "n", "set_hash").join(of_set, "set_hash", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("has_set"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
