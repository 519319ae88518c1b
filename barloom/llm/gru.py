"""Operator 1: log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents. The ``known`` most frequent words have vectors of their own; the words
beyond, and one outcome for all unseen words, form a last class. The output is factored: first the class of the next
word (words by falling frequency, in classes of equal size), then the word in its class; inside the last class words
have their smoothed shares of the counts. So the model gives each word that the base model knows, and the outcome
"unseen", a probability, and all of them sum to one. Biases start at the counts, so an untrained model is the base model.

Weights are fitted by truncated backpropagation: documents run in lanes, the state is carried from window to window
and reset at the start of a document, gradients stop at the window's edge. Every training document is learned once: a
hash of id and text puts it into a group, the groups are dealt over the rounds, and the number of groups follows from the count of
training tokens. Groups of a round start from the same weights and their results are averaged. So the weights depend on the
rows alone, not on how a table is cut into partitions. Scoring carries the state through all windows of a document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, slices

END = b"\n"  # no word has a line break in it, so this names the end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (UTF-8 bytes) in a row, A-Z lower-cased, cut at space and 9..13 only, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(_as_strings(texts)))
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy() > 0  # white space at either end gives an empty word
    if not full.all():
        words, offsets = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    return words, np.diff(offsets)


def _as_strings(texts: pa.Array) -> pa.Array:
    """Bytes seen as strings, not copied: Arrow cuts and lower-cases strings only."""
    return texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())


def _as_bytes(words: pa.Array) -> pa.Array:
    return words.view(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).cast(pa.binary())


def numbers_of(texts: pa.Array, listed: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The place of each token in the list (-1: not in it), texts in a row, the end after each; the number of tokens of each text; the tokens that aren't in the list."""
    words, sizes = words_of(texts)
    sizes = sizes + 1
    is_end = np.zeros(int(sizes.sum()), dtype=bool)
    is_end[np.cumsum(sizes) - 1] = True
    listed, end = _as_strings(listed).cast(words.type), pa.array([END.decode()], words.type)
    numbers = np.empty(len(is_end), dtype=np.int32)
    for mine, tokens in ((~is_end, words), (is_end, end)):
        numbers[mine] = pc.fill_null(pc.index_in(tokens, value_set=listed), -1).to_numpy()
    at = np.full(len(is_end), len(words))
    at[~is_end] = np.arange(len(words))
    rare = pa.concat_arrays([words, end]).take(pa.array(at[numbers < 0]))
    return numbers, sizes, _as_bytes(rare)


def held_out(doc_id: int | None) -> bool:
    """Remainder 1 of crc32 of the id as text; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Vocabulary:
    """The most frequent words with their numbers; all other words by their counts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, classes: int):
        self.number = {w: k for k, w in enumerate(words)}
        self.total, self.distinct = total, distinct
        self.size = -(-max(1, len(words)) // classes)  # words a class
        self.classes = max(1, -(-len(words) // self.size))
        self.counts = counts
        rest = total - int(counts.sum()) + 0.5 * (distinct - len(words) + 1)  # smoothed mass of the last class
        mass = np.zeros((self.classes, self.size))
        mass.ravel()[: len(words)] = counts + 0.5
        with np.errstate(divide="ignore"):
            self.in_class = np.where(mass > 0, np.log(mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)), -1e4).astype(np.float32)
            self.of_class = np.log(np.append(mass.sum(axis=1), rest) / (mass.sum() + rest)).astype(np.float32)
        self.rest = rest


class Weights:
    """All parameters in one flat array, with views by name."""

    def __init__(self, vocabulary: Vocabulary, hidden: int, flat: np.ndarray | None = None, seed: int = 7):
        k, c, s, h = vocabulary.classes * vocabulary.size + 2, vocabulary.classes, vocabulary.size, hidden
        # The last rows of c and of w are biases.
        shapes = {"x": (k, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "c": (h + 1, c + 1), "w": (c, h + 1, s)}
        sizes = [math.prod(v) for v in shapes.values()]
        self.flat = np.zeros(sum(sizes), dtype=np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for (name, shape), size in zip(shapes.items(), sizes):
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size
        if flat is None:
            rng = np.random.default_rng(seed)
            self.x[:] = rng.normal(0, 0.3, self.x.shape)
            self.u[:] = rng.normal(0, 0.5 / math.sqrt(h), self.u.shape)
            self.b[:h] = 1.0  # keep the state at first
            self.c[-1], self.w[:, -1] = vocabulary.of_class, vocabulary.in_class
        self.hidden = h


def _forward(m: Weights, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
    """States (steps+1 x lanes x hidden; the last column of each is 1, for biases) and, if ``keep``, the gates.

    ``inputs`` is the word read at each step; the state after reading it guesses the next word. Sigmoids are taken as
    1 / (1 + exp(-x)) and tanh as 2 / (1 + exp(-2x)) - 1, with the factors in the weights: numpy's exp takes half of its tanh's time.
    """
    h = m.hidden
    steps, lanes = inputs.shape
    # Each gate has arrays of its own, without gaps between rows: operations on slices of wider rows cost several times as much.
    factors = np.array([-1.0, -1.0, -2.0], np.float32)[:, None, None]
    u = np.ascontiguousarray(m.u.reshape(h, 3, h).transpose(1, 0, 2)) * factors
    tables = np.add(m.x.reshape(-1, 3, h).transpose(1, 0, 2), m.b.reshape(3, 1, h), order="C")
    tables *= factors
    gates = np.empty((3, steps if keep else 1, lanes, h), np.float32)  # of one step only, if they aren't kept
    u_gates, u_new = u[:2], u[2]
    hidden = np.empty((steps + 1, lanes, h), np.float32)
    hidden[0] = state
    mixed = np.empty((steps, lanes, h), np.float32) if keep else None
    part, fed = np.empty((lanes, h), np.float32), np.empty((2, lanes, h), np.float32)
    fed_new = fed[0]
    inputs = inputs.astype(np.intp)  # else take converts them, three times over
    any_fresh = fresh.any(axis=1).tolist()
    with np.errstate(over="ignore"):  # an exponent beyond all numbers gives the gate's limit, 0
        for t in range(steps):
            old = hidden[t]
            if any_fresh[t]:
                old = old.copy()
                old[fresh[t]] = 0
            at = t if keep else 0
            for k in range(3):
                tables[k].take(inputs[t], axis=0, out=gates[k, at], mode="clip")
            zr, new, after = gates[:2, at], gates[2, at], hidden[t + 1]
            zr += np.matmul(old, u_gates, out=fed)
            np.exp(zr, out=zr)
            zr += 1
            np.divide(1, zr, out=zr)
            if keep:
                part = mixed[t]
            np.multiply(zr[1], old, out=part)
            new += np.dot(part, u_new, out=fed_new)
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            new -= 1
            np.subtract(old, new, out=after)
            after *= zr[0]
            after += new
    states = np.ones((steps + 1, lanes, h + 1), np.float32)
    states[:, :, :h] = hidden
    return states, gates if keep else None, mixed


BLOCK = 4096  # rows whose logits are worked on at a time, so that they stay in the cache


def _log_shares(logits: np.ndarray, chosen: np.ndarray, bounded: bool, slopes: bool) -> np.ndarray:
    """The log of the share that the ``chosen`` column has of each row's exponents. The logits become exponents or, if ``slopes``, the gradients of -log."""
    at = np.arange(0, logits.size, logits.shape[1])
    at += chosen
    flat = logits.reshape(-1)
    out = flat.take(at)
    if not bounded:
        np.minimum(logits, 60, out=logits)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], np.float32)
    out -= np.log(sums)
    if slopes:
        logits *= np.divide(1, sums, out=sums)[:, None]
        flat[at] -= 1
    return out


def _losses(m: Weights, states: np.ndarray, targets: np.ndarray, size: int, grads: Weights | None):
    """Natural log probability of each target's class, and of the word in it for known words; with gradients if asked.

    targets: word number, or -1 for words of the last class. Rows are taken class by class; products are made for each class, all else for blocks of rows.
    """
    classes, slopes = m.w.shape[0], grads is not None
    cls = np.where(targets >= 0, targets // size, classes).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=classes + 1))]).tolist()
    states, targets, cls = np.take(states, order, axis=0), targets[order], cls[order]
    # Biases are shares, so logits are small; where the weights can't give over 60, none needs to be cut.
    bounded = bool(max((x[..., -1, :] + np.abs(x[..., :-1, :]).sum(axis=-2)).max() for x in (m.c, m.w)) <= 60)
    shares = np.empty(len(targets), np.float32)
    back = np.empty((len(targets), m.hidden), np.float32) if slopes else None
    for a in range(0, len(targets), BLOCK):
        part = slice(a, a + BLOCK)
        logits = states[part] @ m.c
        shares[part] = _log_shares(logits, cls[part], bounded, slopes)
        if slopes:
            grads.c += states[part].T @ logits
            np.matmul(logits, m.c[:-1].T, out=back[part])
    first = 0
    while first < classes:  # the last class has no words of its own
        stop = first + 1
        while stop < classes and cuts[stop + 1] - cuts[first] <= BLOCK:
            stop += 1
        a, b = cuts[first], cuts[stop]
        logits = np.empty((b - a, size), np.float32)
        filled = [(k, slice(cuts[k], cuts[k + 1]), logits[cuts[k] - a : cuts[k + 1] - a]) for k in range(first, stop) if cuts[k] < cuts[k + 1]]
        for k, rows, mine in filled:
            np.dot(states[rows], m.w[k], out=mine)
        shares[a:b] += _log_shares(logits, targets[a:b] - cls[a:b].astype(np.int32) * size, bounded, slopes)
        if slopes:
            more = np.empty((b - a, m.hidden), np.float32)
            for k, rows, mine in filled:
                grads.w[k] += np.dot(states[rows].T, mine)
                np.dot(mine, m.w[k, :-1].T, out=more[rows.start - a : rows.stop - a])
            back[a:b] += more
        first = stop
    out = np.empty_like(shares)
    out[order] = shares
    if slopes:
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        back = np.take(back, place, axis=0)
    return out, back


def _sums_by_word(flat: np.ndarray, words: np.ndarray, often: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and, for each, the sums of its rows of each of the gates (gates x rows x hidden).

    The first rows of all words are added up with their second rows, their third, and so on; words with more than ``often`` rows are summed one by one.
    """
    order = np.argsort(words.astype(np.int16) if words.max() < 1 << 15 else words, kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    counts = np.diff(first, append=len(words))
    by_count = np.argsort(-counts, kind="stable")
    first, counts = first[by_count], counts[by_count]
    many = int(np.searchsorted(-counts, -often))
    sums = np.empty((len(flat), len(first), flat.shape[2]), np.float32)
    for w in range(many):
        mine = order[first[w] : first[w] + counts[w]]
        for k, rows in enumerate(flat):
            sums[k, w] = np.ones(len(mine), np.float32) @ rows.take(mine, axis=0)
    few = first[many:]
    deep = int(counts[many]) if len(few) else 0
    layers = np.searchsorted(-counts[many:], -np.arange(deep), "left").tolist()  # words with more than 0, 1, 2, ... rows
    at = np.concatenate([few[:n] + k for k, n in enumerate(layers)]) if deep else few
    rows = np.empty((len(flat), len(at), flat.shape[2]), np.float32)
    for k in range(len(flat)):
        flat[k].take(order[at], axis=0, out=rows[k], mode="clip")
    total, begin = rows[:, : len(few)], len(few)
    for n in layers[1:]:
        total[:, :n] += rows[:, begin : begin + n]
        begin += n
    sums[:, many:] = total
    return ranked[first], sums


def _backward(m: Weights, grads: Weights, inputs, fresh, states, gates, mixed, back) -> None:
    """Gradients through the window; back: gradients at the states after each step (changed on the way)."""
    h = m.hidden
    steps, lanes = inputs.shape
    old = np.ascontiguousarray(states[:-1, :, :h])
    if fresh.any():
        old[fresh] = 0
    z, r, n = gates
    # The slope of each gate, for all steps at once; what comes back is multiplied in step by step.
    fed = np.empty((3, steps, lanes, h), np.float32)
    dz, dr, dn = fed
    move = 1 - z
    np.subtract(old, n, out=dz)
    dz *= z
    dz *= move
    np.subtract(1, r, out=dr)
    dr *= mixed  # the old state times r
    np.multiply(n, n, out=dn)
    np.subtract(1, dn, out=dn)
    dn *= move
    u = np.ascontiguousarray(m.u.reshape(h, 3, h).transpose(1, 2, 0))  # each gate's, turned
    later, via, more = (np.zeros((lanes, h), np.float32) for _ in range(3))
    any_fresh = fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        g = back[t]
        g += later
        dz[t] *= g
        dn[t] *= g
        np.dot(dn[t], u[2], out=via)
        dr[t] *= via
        g *= z[t]
        via *= r[t]
        np.dot(dz[t], u[0], out=later)
        later += np.dot(dr[t], u[1], out=more)
        later += g
        later += via
        if any_fresh[t]:
            later[fresh[t]] = 0
    flat = fed.reshape(3, -1, h)
    for k, before in enumerate((old, old, mixed)):
        grads.u[:, k * h : (k + 1) * h] += before.reshape(-1, h).T @ flat[k]
    words, sums = _sums_by_word(flat, inputs.ravel())
    sums = sums.transpose(1, 0, 2).reshape(-1, 3 * h)
    grads.x[words] += sums
    grads.b += sums.sum(axis=0)


def lanes_of(docs: list[np.ndarray], lanes: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents in lanes, one after the other, each to the shortest lane, the longest first.

    Arrays steps x lanes: the word read (``start`` at the start of a document, the number before it for rare words), the word to guess, whether a document
    starts, and the place in the row of all documents' words (-1: no word).
    """
    sizes = np.array([len(d) for d in docs])
    lanes = max(1, min(lanes, len(docs), int(sizes.sum()) // int(sizes.max()) + 1))  # a long document alone fills no more
    fill = np.zeros(lanes, dtype=np.int64)
    plan: list[list[int]] = [[] for _ in range(lanes)]
    for k in np.argsort(-sizes, kind="stable"):
        lane = int(fill.argmin())
        plan[lane].append(int(k))
        fill[lane] += sizes[k]
    by_fill = np.argsort(-fill, kind="stable")
    steps = int(fill.max())
    read = np.full((steps, lanes), start, dtype=np.int32)
    guess = np.full((steps, lanes), -1, dtype=np.int32)
    fresh = np.zeros((steps, lanes), dtype=bool)
    place = np.full((steps, lanes), -1, dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    for column, lane in enumerate(by_fill):
        at = 0
        for k in plan[lane]:
            n = int(sizes[k])
            guess[at : at + n, column] = docs[k]
            read[at + 1 : at + n, column] = np.where(docs[k][:-1] >= 0, docs[k][:-1], start - 1)
            fresh[at, column] = True
            place[at : at + n, column] = begin[k] + np.arange(n)
            at += n
    return read, guess, fresh, place


def segments(doc: np.ndarray, most: int) -> list[np.ndarray]:
    """A document cut for learning, so that one long document doesn't run on in a lane by itself; each part starts afresh."""
    return [doc] if len(doc) <= most else [doc[k : k + most] for k in range(0, len(doc), most)]


class Trainer:
    """Truncated backpropagation with per-weight step sizes (sums of squared gradients)."""

    def __init__(self, m: Weights, vocabulary: Vocabulary, window: int, rate: float):
        self.m, self.v, self.window, self.rate = m, vocabulary, window, rate
        self.grads = Weights(vocabulary, m.hidden, np.zeros_like(m.flat))
        self.squares = np.full_like(m.flat, 1e-7)
        self.step = np.empty_like(m.flat)
        self.words = 0

    def learn(self, docs: list[np.ndarray], lanes: int) -> None:
        read, guess, fresh, place = lanes_of(docs, lanes, len(self.m.x) - 1)
        state = np.zeros((read.shape[1], self.m.hidden), np.float32)
        for t in range(0, len(read), self.window):
            live = int((place[t] >= 0).sum())
            part = slice(t, t + self.window)
            inputs, new = read[part, :live], fresh[part, :live]
            states, gates, mixed = _forward(self.m, inputs, new, state[:live], True)
            real = place[part, :live] >= 0
            self.grads.flat[:] = 0
            if real.all():
                _, back = _losses(self.m, states[1:].reshape(real.size, -1), guess[part, :live].ravel(), self.v.size, self.grads)
                spread = back.reshape(*real.shape, -1)
            else:
                _, back = _losses(self.m, states[1:][real], guess[part, :live][real], self.v.size, self.grads)
                spread = np.zeros((*real.shape, self.m.hidden), np.float32)
                spread[real] = back
            _backward(self.m, self.grads, inputs, new, states, gates, mixed, spread)
            self.words += int(real.sum())
            g, step = self.grads.flat, self.step
            g /= read.shape[1] * self.window  # windows with few lanes left move the weights less
            np.clip(g, -1, 1, out=g)
            self.squares *= 0.99
            np.multiply(g, g, out=step)
            step *= 0.01
            self.squares += step
            np.sqrt(self.squares, out=step)
            step += 1e-4
            np.divide(g, step, out=step)
            step *= self.rate
            self.m.flat -= step
            state = states[-1, :, :-1]


def score_words(m: Weights, v: Vocabulary, docs: list[np.ndarray], lanes: int = 256, window: int = 128) -> np.ndarray:
    """Natural log probability of each word (of its class only, for words of the last class), documents in a row; the same for all lanes and windows."""
    total = sum(map(len, docs))
    out = np.zeros(total, dtype=np.float64)
    read, guess, fresh, place = lanes_of(docs, lanes, len(m.x) - 1)
    state = np.zeros((read.shape[1], m.hidden), np.float32)
    for t in range(0, len(read), window):
        live = int((place[t] >= 0).sum())
        part = slice(t, t + window)
        states, _, _ = _forward(m, read[part, :live], fresh[part, :live], state[:live], False)
        real = place[part, :live] >= 0
        real = ... if real.all() else real.ravel()
        got, _ = _losses(m, states[1:].reshape(-1, m.hidden + 1)[real], guess[part, :live].ravel()[real], v.size, None)
        out[place[part, :live].ravel()[real]] = got
        state = states[-1, :, :-1]
    return out


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """Rows (word, n) over the training documents. Each task counts first; its partial counts are summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ends = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            learn = pa.array([not held_out(doc) for doc in batch.column(0).to_pylist()], pa.bool_())
            for part in slices(batch.filter(learn), 1, 4 << 20):
                ends += part.num_rows
                counts = words_of(part.column(1))[0].value_counts()
                held.append(pa.table({"word": _as_bytes(counts.field("values")), "n": counts.field("counts")}))
                if sum(map(len, held)) > 2 * flush:
                    held = [merged()]
                    if len(held[0]) > flush:
                        yield from held.pop().to_batches()
        held.append(pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())}))
        if ends:
            yield from merged().to_batches()

    return _bytes(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: Vocabulary, hidden: int, rounds: int, group_words: int, lanes: int, window: int, rate: float, most_groups: int = 16_384) -> Weights:
    """Rounds of local training and averaging, over every training document once; ``learned`` of the result counts their words.

    A round has as many groups as its share of the training tokens has ``group_words`` (``most_groups`` at most; beyond that
    groups grow). Documents are dealt to groups by a hash of id and text and come in the order of that hash, as numbers of
    known words, two bytes a word. A group is one task, which holds a million words at a time. Repeated rows are one group's.

    The weights are some hundred kilobytes whatever the input; they are averaged block by block in a grouped
    aggregation weighted by words, and one average comes to the driver.
    """
    spark = docs.sparkSession
    m, learned = Weights(vocabulary, hidden), 0
    sent = spark.sparkContext.broadcast(vocabulary)
    block, segment = 4096, 1024
    per_round = min(most_groups, max(1, -(-vocabulary.total // (rounds * group_words))))
    body = _bytes(docs).withColumn("hash", F.xxhash64("doc_id", "text"))
    body = body.withColumn("grp", F.pmod(F.col("hash"), F.lit(rounds * per_round)).cast("int"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(sent.value.number), pa.binary())
        for batch in batches:
            learn = pa.array([not held_out(i) for i in batch.column(0).to_pylist()], pa.bool_())
            for part in slices(batch.filter(learn), 1, 4 << 20):
                numbers, sizes, _ = numbers_of(part.column(1), known)
                offsets = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(numbers.astype(np.int16))])
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(2), words], names=["grp", "hash", "words"])

    for r in range(rounds):
        start = spark.sparkContext.broadcast(m.flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            v: Vocabulary = sent.value
            group, trainer, held, held_words = None, None, [], 0

            def result() -> pa.RecordBatch:
                if held:
                    trainer.learn(held, lanes)
                flat = trainer.m.flat.astype(np.float64) * trainer.words
                parts = [flat[k : k + block] for k in range(0, len(flat), block)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([group] * len(parts), pa.int32()), pa.array([trainer.words] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))],
                    names=["part", "grp", "words", "sums"],
                )

            for batch in batches:
                for grp, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                    if grp != group:
                        if group is not None:
                            yield result()
                        group, trainer, held, held_words = grp, Trainer(Weights(v, hidden, start.value.copy()), v, window, rate / (1 + r)), [], 0
                    doc = np.frombuffer(raw.as_buffer(), np.int16).astype(np.int32)
                    held += segments(doc, segment)
                    held_words += len(doc)
                    if held_words > 1_000_000:
                        trainer.learn(held, lanes)
                        held, held_words = [], 0
            if group is not None:
                yield result()

        chosen = body.where(F.pmod("grp", F.lit(rounds)) == r).mapInArrow(numbered, "grp int, hash long, words binary")
        dealt = chosen.repartition(per_round, "grp").sortWithinPartitions("grp", "hash")
        local = dealt.mapInArrow(run, "part int, grp int, words long, sums array<double>")

        def add(rows: pa.Table, part, grp) -> pa.Table:
            rows = rows.sort_by("grp")  # one order of the sums, so that equal rows give equal weights
            sums = np.zeros(len(rows.column("sums")[0]))
            for x in rows.column("sums"):
                sums += x.values.to_numpy()
            return pa.table({"part": pa.array([part], pa.int32()), "grp": pa.array([grp], pa.int32()), "words": pa.array([sum(rows.column("words").to_pylist())], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})

        # Sums meet in two steps, so that no task holds more than some hundred of them.
        schema = "part int, grp int, words long, sums array<double>"
        halves = local.withColumn("half", F.floor(F.col("grp") / 128).cast("int"))
        first = halves.groupBy("part", "half").applyInArrow(lambda key, rows: add(rows, key[0].as_py(), key[1].as_py()), schema)
        mean = first.groupBy("part").applyInArrow(lambda key, rows: add(rows, key[0].as_py(), 0), schema).orderBy("part").collect()
        if mean:
            m = Weights(vocabulary, hidden, np.concatenate([np.array(x.sums) / x.words for x in mean]))
            learned += mean[0].words
    m.learned = learned
    return m


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """The words of at least a certain count (rows word, n; the most frequent first): of the lowest count for which they are ``most`` or fewer.

    The count is found from a histogram of counts of some thousand bins, so no task gathers words.
    """
    n = F.col("n")
    bin_of = F.when(n < 4096, n).otherwise(4096 + F.floor((F.log2(n.cast("double")) - 12) * 64)).cast("long")
    least, taken = None, 0
    for row in sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), key=lambda row: -row["bin"]):
        taken += row["count"]
        if taken > most:
            break
        least = row["bin"]
    top = counts.where(F.lit(False) if least is None else bin_of >= least).select("word", "n").toArrow()
    return top.sort_by([("n", "descending"), ("word", "ascending")])


def score(
    docs: DataFrame, known: int = 2000, listed: int = 200_000, classes: int = 40, hidden: int = 24, rounds: int = 2, group_words: int = 2_000_000, lanes: int = 256, window: int = 16, rate: float = 0.015
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text, read as words and an end.

    Counts are over all training documents, and the recurrent weights are fitted on all of them, each in one of ``rounds``
    rounds (see ``fit``), so equal rows give equal scores however they are partitioned. The counts of the most frequent words,
    ``listed`` at most, go to the executors; those of rarer words are joined by word. Scores are log10.

    Null texts count as empty, a null id hashes as the empty text, repeated rows are scored alike, extra columns are
    ignored; an empty table gives no rows; without training words all words are unseen.
    """
    spark = docs.sparkSession
    counts = cut(word_counts(docs), "words")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, listed)
    words, numbers = top.column("word").to_pylist(), top.column("n").to_numpy()
    vocabulary = Vocabulary(words[:known], numbers[:known], whole["n"], whole["v"], classes)
    m = fit(docs, vocabulary, hidden, rounds, group_words, lanes, window, rate)
    sent = spark.sparkContext.broadcast((vocabulary, m.flat, hidden, top.column("word").combine_chunks(), np.log(numbers + 0.5)))
    spread = math.log(whole["n"] + 0.5 * (whole["v"] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat, hidden, listed, logs = sent.value
        m = Weights(v, hidden, flat)
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                numbers, sizes, rare = numbers_of(part.column(1), listed)
                per = np.add.reduceat((numbers < 0).astype(np.int64), np.cumsum(sizes) - sizes)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), rare)
                held.append((part.column(0), part.column(2), sizes, numbers, rare))
                if sum(len(h[3]) for h in held) > 2_000_000:  # long documents need many others beside them
                    yield from settle(held, v, m, logs)
                    held = []
        if held:
            yield from settle(held, v, m, logs)

    def settle(held: list[tuple], v: Vocabulary, m: Weights, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes, numbers = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        ends = np.cumsum(sizes)
        known_numbers = np.where(numbers < len(v.counts), numbers, -1).astype(np.int32)
        got = score_words(m, v, np.split(known_numbers, ends[:-1]))
        each = np.append(logs, 0.0)[numbers]  # 0 for words not in the list
        total = lambda x: np.add.reduceat(x, ends - sizes)
        columns = [total((numbers >= 0).astype(np.int64)), total((known_numbers < 0).astype(np.int64)), total(each), total(got + np.where(known_numbers < 0, each, 0.0))]
        at = 0
        for ids, keys, n, _, rare in held:
            part = slice(at, at + len(n))
            at += len(n)
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(n, pa.int64()), *[pa.array(c[part]) for c in columns], rare],
                names=["doc_id", "key", "held_out", "n_tokens", "n_listed", "n_tail", "base", "neural", "rare"],
            )

    body = _bytes(docs).withColumn("key", F.xxhash64("text", F.octet_length("text")))
    scored = cut(body.mapInArrow(run, "doc_id long, key long, held_out boolean, n_tokens long, n_listed long, n_tail long, base double, neural double, rare array<binary>"), "scored")
    # Rarer words: their counts by a join. Sums are by text, so equal texts share them.
    rows = scored.groupBy("key").agg(F.count("*").alias("copies"))
    found = scored.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    sums = found.groupBy("key").agg(F.sum(F.ln(F.coalesce("n", F.lit(0)) + 0.5)).alias("s"), F.count("n").alias("c")).join(rows, "key")
    sums = sums.select("key", (F.col("s") / F.col("copies")).alias("s"), (F.col("c") / F.col("copies")).cast("long").alias("c"))
    more, ten = F.coalesce(F.col("s"), F.lit(0.0)), math.log(10)
    return scored.drop("rare").join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_listed") + F.coalesce("c", F.lit(0))).alias("n_known"),
        F.lit(int(whole["n"])).cast("long").alias("train_tokens"),
        ((F.col("base") + more - F.col("n_tokens") * spread) / ten).alias("base_score"),
        ((F.col("neural") + more - F.col("n_tail") * math.log(vocabulary.rest)) / ten).alias("score"),
    )
