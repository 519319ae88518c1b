"""Operator 13: spelling variants, by rolling hashes of deletions.

Two words are near if one inserted, deleted or replaced code point is all that parts them. Every word gives keys: its own hash,
the hash of what is left when a code point is deleted, and that hash again with the place of the deletion. Words that differ by a
replaced code point share the key of its place; a word with an insertion shares a deletion's key with the other's own. Hashes of
prefixes are running sums, those of suffixes what is left of the whole, so all deletions of all words of a batch are a few array
operations. Keys are partitioned by their high bits and sorted there; what meets under one key is verified on the strings.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, group_runs, mix64, slices
from barloom.llm.crc import Joiner

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")

_P = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
_BASE = (np.uint64(1_103_515_245), np.uint64(1_566_083_941))

_KEY = np.dtype([("key", np.uint64), ("id", np.int64), ("place", np.int32), ("kind", np.int8)])

#: What a key is made from: the whole word, a deletion, a deletion with its place.
WHOLE, LESS, PLACE = 0, 1, 2


class _Vocabulary(dict):
    """Runs as they were read, numbered; with each run's lower-cased form, its CRC, bytes and code points."""

    def __init__(self) -> None:
        self.words, self.crc, self.bytes, self.points = [], [], [], []

    def __missing__(self, run: str) -> int:
        value = self[run] = len(self.words)
        raw = run.encode().lower()
        self.words.append(raw.decode())
        self.crc.append(zlib.crc32(raw))
        self.bytes.append(len(raw))
        self.points.append(len(run))
        return value


def parts_of(text: str, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` code points that end between runs."""
    start = 0
    while start < len(text):
        end = start + most
        if end < len(text):
            gap = NO_RUN.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def word_counts(docs: DataFrame, spoil: int = 97, least_points: int = 5, most_bytes: int = 4 << 20, most_words: int = 200_000) -> DataFrame:
    """Rows (word, n): the lower-cased runs of letters of all texts, of ``least_points`` code points or more.

    Where ``spoil`` divides the CRC-32 of ``<doc_id>:<run>``, a code point of the run is deleted first (that of the CRC modulo the
    length). Counts are added up in each task before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner, known, spoiled = Joiner(), _Vocabulary(), Counter()
        counts = np.zeros(0, dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            total = Counter(spoiled)
            for word, n in zip(known.words, counts.tolist()):
                if n and len(word) >= least_points:
                    total[word] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        def take(owner: list[int], ids: list[int], heads: np.ndarray) -> None:
            nonlocal counts
            crc, size, points = (np.array(x, dtype=t) for x, t in ((known.crc, np.uint32), (known.bytes, np.int64), (known.points, np.int64)))
            word, doc = np.array(ids, dtype=np.int64), np.array(owner, dtype=np.int64)
            h = joiner.join(heads[doc], crc[word], size[word])
            hit = h % np.uint32(spoil) == 0
            counts = np.pad(counts, (0, len(crc) - len(counts))) + np.bincount(word[~hit], minlength=len(crc))
            hit &= points[word] > least_points
            for w, k in zip(word[hit].tolist(), (h[hit].astype(np.int64) % points[word[hit]]).tolist()):
                whole = known.words[w]
                spoiled[whole[:k] + whole[k + 1 :]] += 1

        for batch in batches:
            for part in slices(batch, 1, most_bytes):
                heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in part.column(0).to_pylist()], dtype=np.uint32)
                owner, ids = [], []
                for doc, text in enumerate(part.column(1).to_pylist()):
                    for piece in parts_of(text, most_bytes):
                        found = [known[x] for x in RUN.findall(piece)]
                        ids += found
                        owner += [doc] * len(found)
                        if len(ids) >= most_bytes // 4:
                            take(owner, ids, heads)
                            owner, ids = [], []
                if ids:
                    take(owner, ids, heads)
                if len(known) + len(spoiled) >= most_words:
                    yield from flush()
                    known, counts = _Vocabulary(), np.zeros(0, dtype=np.int64)
                    spoiled.clear()
        yield from flush()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: np.uint64, p: np.uint64, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    step = base
    while len(out) < n:  # out holds powers 0 .. len - 1, step is base ** len
        out = np.concatenate([out, out * step % p])
        step = step * step % p
    return out[:n]


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys of ``words``: the key, the word's number, the kind and the place of the deletion.

    A string's hash is the sum of its code points times powers of a base, modulo two primes. Without place k it is the sum before
    k, and the sum after k divided by the base. A deletion inside a row of equal code points is named once, at the row's start;
    with its place, each counts.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(points)) - starts[word]
    whole, less = np.zeros(len(words), dtype=np.uint64), np.zeros(len(points), dtype=np.uint64)
    for shift, p, base in zip((32, 0), _P, _BASE):
        term = points * _powers(base, p, int(length.max(initial=0)))[place] % p
        upto = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])
        first = upto[starts]
        total = (upto[starts + length] - first) % p
        before = (upto[:-1] - first[word]) % p
        after = (total[word] + p - (before + term) % p) % p
        inverse = np.uint64(pow(int(base), -1, int(p)))
        whole |= total << np.uint64(shift)
        less |= ((before + after * inverse % p) % p) << np.uint64(shift)
    whole = mix64(whole + mix64(length.astype(np.uint64)))
    less = mix64(less + mix64(length[word].astype(np.uint64) - np.uint64(1)))
    fresh = np.ones(len(points), dtype=bool)
    fresh[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
    placed = mix64(less ^ mix64(place.astype(np.uint64) + np.uint64(1)))
    key = np.concatenate([whole, less[fresh], placed])
    owner = np.concatenate([np.arange(len(words)), word[fresh], word])
    kind = np.repeat(np.array([WHOLE, LESS, PLACE], dtype=np.int8), [len(words), int(fresh.sum()), len(points)])
    return key, owner, kind, np.concatenate([np.zeros(len(words), np.int64), place[fresh], place])


def shared(key: np.ndarray) -> np.ndarray:
    """The rows, in order of key, of the keys that occur more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    return order[np.append(same, False) | np.append(False, same)] if len(key) else order


def near_words(words: DataFrame, batch_bytes: int = 256 << 10, radix_rows: int = 1_000_000) -> DataFrame:
    """Rows (id, n_near, form_id, form, form_n) for the ``words`` (id, word, n; each word once) that have near words.

    ``form`` is the near word of largest n, ties to the smallest in code-point order. No group grows with the corpus: under
    one key are the words that one code point at one place tells apart, or that one insertion makes of one word.
    """
    rows = words.agg(F.sum(2 * F.char_length("word") + 1)).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, rows / radix_rows))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, batch_bytes):
                key, owner, kind, place = deletion_keys(part.column(1).to_pylist())
                radix = (key >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(radix, kind="stable")
                rows = np.empty(len(key), dtype=_KEY)
                rows["key"], rows["id"], rows["place"], rows["kind"] = key, part.column(0).to_numpy()[owner], place, kind
                rows = rows[order]
                cuts = np.flatnonzero(np.append(True, radix[order][1:] != radix[order][:-1]))
                blocks = [rows[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(rows)))]
                yield pa.RecordBatch.from_arrays([pa.array(radix[order][cuts], pa.int64()), pa.array(blocks, pa.binary())], names=["radix", "keys"])

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        radix = table.column("radix").to_numpy()
        blocks = [np.frombuffer(x, dtype=_KEY) for x in table.column("keys").to_pylist()]
        for r in np.unique(radix).tolist():
            rows = np.concatenate([blocks[k] for k in np.flatnonzero(radix == r)])
            rows = rows[shared(rows["key"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), r)), *(pa.array(rows[c].astype(np.int64)) for c in ("id", "place")), pa.array(rows["kind"].astype(np.int8)), pa.array(rows["key"].copy().view(np.int64))],
                names=["radix", "id", "place", "kind", "key"],
            )

    keys = words.select("id", "word").mapInArrow(spread, "radix long, keys binary")
    meeting = group_runs(keys, "radix", met, "radix long, id long, place long, kind byte, key long", rows=1_000_000, most_bytes=16 << 20).join(words, "id")

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = shared(table.column("key").to_numpy())
        key, ids, kind, place, word, n = (table.column(c).take(pa.array(at)).to_pylist() for c in ("key", "id", "kind", "place", "word", "n"))
        found: list[tuple[int, int, int, str, int]] = []
        start = 0
        while start < len(key):
            stop = start
            wholes: dict[str, int] = {}
            less: dict[str, list[int]] = defaultdict(list)
            placed: dict[tuple[int, str], list[int]] = defaultdict(list)
            while stop < len(key) and key[stop] == key[start]:
                if kind[stop] == WHOLE:
                    wholes[word[stop]] = stop
                else:
                    left = word[stop][: place[stop]] + word[stop][place[stop] + 1 :]
                    (less[left] if kind[stop] == LESS else placed[place[stop], left]).append(stop)
                stop += 1
            rank = lambda r: (-n[r], word[r])
            for text, longer in less.items():
                if text in wholes:
                    own, best = wholes[text], min(longer, key=rank)
                    found.append((ids[own], len(longer), n[best], word[best], ids[best]))
                    found += [(ids[r], 1, n[own], word[own], ids[own]) for r in longer]
            for members in placed.values():
                if len(members) > 1:
                    first, second = sorted(members, key=rank)[:2]
                    for r in members:
                        best = second if r == first else first
                        found.append((ids[r], len(members) - 1, n[best], word[best], ids[best]))
            start = stop
        columns = list(zip(*found)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["id", "near", "form_n", "form", "form_id"]
        )

    pairs = group_runs(meeting, "radix", verify, "id long, near long, form_n long, form string, form_id long", rows=100_000)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form", "form_id")).alias("best")
    return pairs.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("best.form_id").alias("form_id"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """Rows (id, root) for ``links`` (id, form_id): the id that following forms ends at. Each round doubles the steps taken; forms at least double n, so a handful of rounds ends it."""
    up = cut(links.select("id", F.col("form_id").alias("root")), "up")
    while True:
        step = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = cut(up.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        up = further.select("id", "root")
        if not further.where("moved").limit(1).count():
            return up


def group(docs: DataFrame, least: int = 3, ratio: int = 2, spoil: int = 97, least_points: int = 5, batch_bytes: int = 256 << 10, radix_rows: int = 1_000_000) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word that occurs ``least`` times or more.

    ``form`` is the most frequent near word, if it occurs at least ``ratio`` (2 or more) times as often as the word; ``root`` is where following forms
    ends, the word itself without a form. Null and empty texts have no words; a null doc_id reads as an empty one. Repeated rows count
    each. Ties go to the smaller word in code-point order. Extra columns are ignored; an empty table gives no rows.
    """
    counts = word_counts(docs, spoil, least_points).where(F.col("n") >= least)
    words = cut(cut(counts, "counts").withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"), "words")
    near = near_words(words, batch_bytes, radix_rows)
    able = F.col("form_n") >= ratio * F.col("n")
    known = cut(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(able, F.col(c)).alias(c) for c in ("form_id", "form", "form_n")]), "near")
    tops = roots(known.where("form_id is not null")).join(words.select(F.col("id").alias("root"), F.col("word").alias("top")), "root").select("id", "top")
    return known.join(tops, "id", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
