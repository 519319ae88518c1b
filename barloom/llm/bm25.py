"""Operator 3: benchmark decontamination by a BM25 index of test items with block-max WAND.

The test items are the indexed documents, the passages of the training texts are the queries. A passage has as many
words as the longest item; passages overlap by half. The rarity of a term is counted over all training texts. The
score of an item is its BM25 score divided by the score of the item's own text, so one threshold serves all items. The
block maxima of a text's terms are summed for all its passages at once; only passages in which they reach the threshold
for some block of items are walked by ``retrieve``, which gives every item at or above it. Retrieved items are verified on
the whole training text: the part of the item's shingles that occurs in it, for the question and the answer part apart, or for the whole item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import scan_texts

_BARE = re.compile(r"\w+")
K1, B = 1.2, 0.75
MOST_BLOCKS = 64


def terms_of(text: str) -> list[str]:
    return _BARE.findall(text.lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer of an item: the last sentence answers; a lone sentence is cut before its last quarter."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if _BARE.search(s)]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in terms_of(s)], terms_of(sentences[-1])
    words = terms_of(text)
    at = len(words) - len(words) // 4
    return words[:at], words[at:]


class Index:
    """Postings by term with block maxima. Impacts are parts of an item's own score, so that its own text scores one."""

    def __init__(self, items: list[tuple[int, str]], found: dict[str, int], n: int):
        """``found``: in how many of ``n`` training texts a term occurs."""
        kept = [(i, terms_of(t), *parts_of(t)) for i, t in items if t and terms_of(t)]
        self.ids = [k[0] for k in kept]
        self.questions = [k[2] for k in kept]
        self.answers = [k[3] for k in kept]
        mean = sum(len(k[1]) for k in kept) / max(1, len(kept))
        longest = max((len(k[1]) for k in kept), default=0)
        self.window = max(32, longest + longest % 2)
        self.term: dict[str, int] = {t: k for k, t in enumerate(dict.fromkeys(t for k in kept for t in k[1]))}
        idf = {t: math.log(1 + (n - found.get(t, 0) + 0.5) / (found.get(t, 0) + 0.5)) for t in self.term}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for item, (_, words, *_) in enumerate(kept):
            counts = Counter(words)
            norm = K1 * (1 - B + B * len(words) / mean)
            own = {t: idf[t] * c * (K1 + 1) / (c + norm) for t, c in counts.items()}
            whole = sum(own.values())
            for t, v in own.items():
                lists[self.term[t]].append((item, v / whole))
        self.items = [np.array([i for i, _ in p], dtype=np.int64) for p in lists]
        self.impacts = [np.array([v for _, v in p]) for p in lists]
        block = max(4, -(-len(kept) // MOST_BLOCKS))
        self.ceilings = np.zeros((len(lists), -(-len(kept) // block)), dtype=np.float32)  # term x block of items
        for t, (i, v) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.ceilings[t], i // block, v.astype(np.float32))
        self.top = np.array([v.max() for v in self.impacts]) if lists else np.zeros(0)
        self.block = block

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct ``terms`` is at least ``threshold``, by block-max WAND.

        The lists are kept in order of the item each stands at. The pivot is the first list at which the maxima of
        the lists so far reach the threshold; if their maxima in the pivot's block don't, the items up to the end of the
        block, or to the next list, are passed over at once.
        """
        slack = threshold - 1e-12
        at = {t: 0 for t in terms}
        out = []
        items, end = self.items, 1 << 60

        def here(t: int) -> int:
            return int(items[t][at[t]]) if at[t] < len(items[t]) else end

        def seek(t: int, item: int) -> None:
            at[t] += int(np.searchsorted(items[t][at[t] :], item))

        live = list(terms)
        while True:
            live = sorted((t for t in live if here(t) < end), key=here)
            reach, pivot = 0.0, None
            for k, t in enumerate(live):
                reach += self.top[t]
                if reach >= slack:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = here(live[pivot])
            while pivot + 1 < len(live) and here(live[pivot + 1]) == item:
                pivot += 1
            if self.ceilings[live[: pivot + 1], item // self.block].sum() < slack - 1e-5:
                after = (item // self.block + 1) * self.block
                if pivot + 1 < len(live):
                    after = min(after, here(live[pivot + 1]))
                for t in live[: pivot + 1]:
                    seek(t, after)
            elif here(live[0]) == item:
                score = sum(float(self.impacts[t][at[t]]) for t in live[: pivot + 1] if here(t) == item)
                if score >= slack:
                    out.append((item, score))
                for t in live[: pivot + 1]:
                    seek(t, item + 1)
            else:
                for t in live[:pivot]:
                    if here(t) < item:
                        seek(t, item)

    def brute(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        score = np.zeros(len(self.ids))
        for t in terms:
            score[self.items[t]] += self.impacts[t]
        return [(int(i), float(score[i])) for i in np.flatnonzero(score >= threshold - 1e-12)]


class _Terms(dict):
    """Term number of a raw word, or -1 if it is no term of the index; a word of several terms is -2 less its place in ``several``."""

    def __init__(self, term: dict[str, int]):
        super().__init__()
        self.term, self.several = term, []

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        parts = _BARE.findall(word)
        if len(parts) == 1:
            value = self.term.get(parts[0], -1)
        else:
            value = -2 - len(self.several)
            self.several.append(tuple(self.term.get(p, -1) for p in parts))
        self[word] = value
        return value

    def numbers(self, raw: list[str]) -> np.ndarray:
        """The term numbers of a text's words, in order."""
        if len(self.several) > 100_000:
            self.clear()
            self.several.clear()
        out = np.fromiter(map(self.__getitem__, raw), dtype=np.int64, count=len(raw))
        if len(out) and out.min() < -1:
            out = np.array([x for v in out.tolist() for x in (self.several[-2 - v] if v < -1 else (v,))], dtype=np.int64)
        return out


def _containment(part: list[str], grams: set[tuple[str, ...]], size: int) -> float:
    if not part:
        return 1.0
    size = min(size, len(part))
    own = {tuple(part[k : k + size]) for k in range(len(part) - size + 1)}
    return len(own & grams) / len(own)


def verify(index: Index, item: int, words: list[str], size: int) -> tuple[float, float]:
    """The parts of the question's and of the answer's shingles of ``size`` words (fewer if it is shorter) that are in ``words``."""
    out = []
    for part in (index.questions[item], index.answers[item]):
        span = min(size, len(part))
        grams = {tuple(words[k : k + span]) for k in range(len(words) - span + 1)} if span else set()
        out.append(_containment(part, grams, size))
    return out[0], out[1]


def verify_whole(index: Index, item: int, words: list[str], size: int) -> float:
    """The part of the shingles of the item's whole text that is in ``words``."""
    part = index.questions[item] + index.answers[item]
    span = min(size, len(part))
    return _containment(part, {tuple(words[k : k + span]) for k in range(len(words) - span + 1)}, size)


def leaks_of(index: Index, raw: list[str], lookup: _Terms, threshold: float, overlap: float, size: int) -> list[tuple[int, float, float, float]]:
    """(item, best score, question overlap, answer overlap) of the leaked items in the words of one text."""
    terms = lookup.numbers(raw)
    n = len(terms)
    if not n or not len(index.top):
        return []
    # All passages at once: the block maxima of a passage's terms must reach the threshold in some block. A term counts
    # once in each half of a passage.
    window = index.window
    step = window // 2
    known = np.flatnonzero(terms >= 0)
    _, first = np.unique(known // step * len(index.top) + terms[known], return_index=True)
    begins = np.arange(0, max(1, n - step), step)
    halves = np.zeros((len(begins) + 1, index.ceilings.shape[1]), dtype=np.float32)
    picked = known[np.sort(first)]
    if len(picked):
        runs = np.flatnonzero(np.diff(picked // step, prepend=-1))
        halves[picked[runs] // step] = np.add.reduceat(index.ceilings[terms[picked]], runs, axis=0)
    reach = (halves[:-1] + halves[1:]).max(axis=1)
    best: dict[int, float] = {}
    for b in begins[reach >= threshold - 1e-4]:
        passage = terms[b : b + window]
        for item, score in index.retrieve(np.unique(passage[passage >= 0]).tolist(), threshold):
            best[item] = max(best.get(item, 0.0), score)
    if not best:
        return []
    words = [p for w in raw for p in _BARE.findall(w)]
    out = []
    for item, score in sorted(best.items()):
        question, answer = verify(index, item, words, size)
        if (question >= overlap and answer >= overlap) or verify_whole(index, item, words, size) >= overlap:
            out.append((item, score, question, answer))
    return out


def _counts(docs: DataFrame, term: dict[str, int]) -> tuple[dict[str, int], int]:
    """In how many texts of ``docs`` each term occurs, and the number of texts; what comes to the driver is one row a term."""
    shared = docs.sparkSession.sparkContext.broadcast(term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, width = _Terms(shared.value), len(shared.value)
        total, texts = np.zeros(width + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = lookup.numbers(list(set(text.lower().split())))
                total[np.unique(seen[seen >= 0])] += 1
                texts += 1
        total[width] = texts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    whole = docs.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_number = {r.term: r.n for r in whole.collect()}
    return {t: by_number.get(k, 0) for t, k in term.items()}, by_number.get(len(term), 0)


def _indexes(docs: DataFrame, benchmark: DataFrame, slice_items: int) -> Iterator[Broadcast]:
    """The index, in slices of about ``slice_items`` items, each with counts over all texts of ``docs``.

    Items of over four times the middle length have slices of their own, by doublings, as the longest item sets the length of passages.
    """
    n = benchmark.count()
    for k in range(max(1, -(-n // slice_items))):
        part = benchmark.select("item_id", "text")
        if n > slice_items:
            part = part.where(f"pmod(xxhash64(item_id), {-(-n // slice_items)}) = {k}")
        items = sorted(((r[0], r[1] or "") for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        sizes = [len(terms_of(t)) for _, t in items]
        usual = 4 * sorted(sizes)[len(sizes) // 2] if sizes else 0
        classes = [0 if size <= usual else 1 + int(math.log2(size / max(1, usual))) for size in sizes]
        for chosen in sorted(set(classes)) or [0]:
            some = [item for item, c in zip(items, classes) if c == chosen]
            terms = {t: k for k, t in enumerate(dict.fromkeys(w for _, t in some for w in terms_of(t)))}
            yield docs.sparkSession.sparkContext.broadcast(Index(some, *_counts(docs, terms)))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, size: int = 5, slice_items: int = 20_000) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): each benchmark item that a text holds.

    Every passage of every whole text is a query; an item counts if a passage reaches ``threshold`` of the item's own
    score and both its parts, or its whole text, are in the text by ``overlap`` or more, in shingles of ``size`` words (fewer if the part is
    shorter). As passages overlap by half, three quarters of any item lie inside one passage. The index goes to the
    executors in slices of ``slice_items`` items, each a scan of its own, so what is broadcast is bounded whatever the
    benchmark. Null or empty texts and items match nothing, a null id stays null, equal items and rows each give rows,
    empty tables give no rows, extra columns are ignored.
    """
    out = None
    for shared in _indexes(docs, benchmark, slice_items):

        def fn(columns: list[pa.Array], shared=shared) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            if not hasattr(index, "lookup"):
                index.lookup = _Terms(index.term)
            rows = []
            for doc, text in zip(columns[0].to_pylist(), columns[1].to_pylist()):
                for item, score, q, a in leaks_of(index, text.lower().split(), index.lookup, threshold, overlap, size):
                    rows.append((doc, index.ids[item], score, q, a))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 3))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = scan_texts(docs, fn, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, size: int = 5, slice_items: int = 20_000) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, as ``leaks`` finds them, whatever their doc_id; no text is dealt out."""
    out = docs
    for shared in _indexes(docs, benchmark, slice_items):
        out = out.where(_free_of(shared, threshold, overlap, size)(F.coalesce("text", F.lit(""))))
    return out


def _free_of(shared: Broadcast, threshold: float, overlap: float, size: int):
    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        index: Index = shared.value
        if not hasattr(index, "lookup"):
            index.lookup = _Terms(index.term)
        return pd.Series([not leaks_of(index, t.lower().split(), index.lookup, threshold, overlap, size) for t in texts], dtype=bool)

    return free
