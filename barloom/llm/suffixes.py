"""Operator 4: exact removal of repeated passages, by suffix arrays.

Every 200-byte window is assigned to the least hash among its 64-byte pieces (its anchor), so equal windows have equal
anchors, and the windows of one anchor form one span of text. Spans go to tasks by their anchor. The spans of an anchor that
very many rows hold are first cut into cells of windows by their start against the anchor; a cell goes to tasks by its core, the bytes
that all its windows share, and equal spans met in one task are sent once. Spans (or cells) alone in their task hold nothing
repeated; those with equal bytes, by a 128-bit hash, are repeated as a whole. What is left, spans that share an anchor but
differ, is settled by suffix arrays of their texts: two neighbours in suffix order that agree in 200 bytes are repeated windows.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes; groups are taken in
descending order, and the previous smaller suffixes of a group's members are moved to groups of their own; then the
order inside all groups is read off from the smallest suffix on, along the same pointers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, group_runs, mix64, ragged, slices, text_bytes

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BACK = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _ODD, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def piece_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """The hash of each piece of ``size`` bytes, from sums of bytes times powers; empty if there is none."""
    n = len(flat)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + _U(1)) * up, out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * down[: n - size + 1])


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: the least from each block's end back, and from its start on."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = values
    table = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans_of(flat: np.ndarray, offsets: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """Spans of all texts: document, first window, count of windows, anchor hash. Texts under ``length`` bytes have none."""
    hashes = piece_hashes(flat, piece)
    empty = np.zeros(0, np.int64)
    if len(flat) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    bits = max(1, int(len(hashes)).bit_length())
    place = np.arange(len(hashes), dtype=np.uint64)
    # The place in the low bits makes the first of equal hashes the least.
    least = least_in_windows((hashes >> _U(bits) << _U(bits)) | place, length - piece + 1)
    anchor = (least & _U((1 << bits) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    begin, end = offsets[long], offsets[long] + sizes[long] - length + 1
    edge = np.zeros(len(anchor) + 1, dtype=np.int8)
    edge[begin] = 1
    valid = np.zeros(len(anchor) + 1, dtype=np.int8)
    valid[begin] += 1
    np.subtract.at(valid, end, 1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside & ((edge[:-1] > 0) | np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first = np.flatnonzero(new)
    doc = np.searchsorted(offsets, first, "right") - 1
    stop = np.append(first[1:], len(anchor))
    stop = np.minimum(stop, offsets[doc] + sizes[doc] - length + 1)
    return doc, first - offsets[doc], stop - first, hashes[anchor[first]]


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of ``text``, whose last symbol is 0 and occurs once, by linear grouping.

    Groups are ranges of ``order``; ``group`` has the start of each suffix's group, ``size`` the sizes by start.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable").tolist()
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    last, start = -1, 0
    for k, i in enumerate(order):
        if text[i] != last:
            last, start = text[i], k
        place[i], group[i] = k, start
        size[start] += 1
    smaller = [-1] * n
    # First part: groups in descending order. Members come by place in the text, so those before are settled.
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # Previous smaller suffixes leave their groups for new ones just behind, those met most often last.
        if times:
            by_group: dict[int, list[tuple[int, int]]] = {}
            for p, c in times.items():
                by_group.setdefault(group[p], []).append((c, p))
            for g, moved in by_group.items():
                if len(moved) == 1 and size[g] == 1:
                    continue
                moved.sort(reverse=True)
                k = 0
                while k < len(moved):
                    c, first = moved[k][0], k
                    tail = g + size[g]
                    while k < len(moved) and moved[k][0] == c:
                        tail -= 1
                        p = moved[k][1]
                        other = order[tail]
                        at = place[p]
                        order[at], order[tail] = other, p
                        place[other], place[p] = at, tail
                        k += 1
                    size[g] -= k - first
                    for _, p in moved[first:k]:
                        group[p] = tail
                    size[tail] = k - first
        end = start
    # Second part: from the smallest suffix on; whoever is met takes the next place of its group.
    out = [-1] * n
    free = list(range(n))
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = smaller[j]
    return out


def _same_bytes(flat: np.ndarray, a: np.ndarray, b: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """For each two neighbouring pieces a..b-1 of ``flat`` (those asked for), whether they have the same bytes; their lengths are."""
    pairs = np.arange(len(a) - 1) if asked is None else np.flatnonzero(asked)
    out = np.zeros(max(0, len(a) - 1), dtype=bool)
    for k in range(0, len(pairs), 20_000):
        p = pairs[k : k + 20_000]
        size = b[p] - a[p]
        differ = flat[ragged(a[p], size)] != flat[ragged(a[p + 1], size)]
        out[p] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return out


def repeated_windows(flat: np.ndarray, offsets: np.ndarray, lead: np.ndarray, group: np.ndarray, length: int, piece: int, cell: int = 16) -> np.ndarray:
    """For spans in a row (texts cut at ``offsets``, ``lead`` bytes before the anchor, group numbers): which windows occur twice.

    The result has a flag for each window of each span, in a row. Windows are laid into cells by their start against the
    anchor. All windows of a cell share a core; spans with different cores share nothing there, and the core is one
    symbol in the texts that are suffix-sorted, so these have at most twice ``cell`` symbols.
    """
    windows = np.diff(offsets) - length + 1
    first_window = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), dtype=bool)
    n = len(flat)
    up, down = _powers(max(1, n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + _U(1)) * up, out=sums[1:])
    hashed = lambda a, b: mix64((sums[b] - sums[a]) * down[a])
    # Cells: starts from reach (the farthest before the anchor) on, ``cell`` a time.
    reach = length - piece
    lowest = reach - lead  # of the first window, counted from the reach
    first_cell, last_cell = lowest // cell, (lowest + windows - 1) // cell
    per = last_cell - first_cell + 1
    span = np.repeat(np.arange(len(windows)), per)
    number = np.arange(len(span)) - np.repeat(np.cumsum(per) - per, per) + first_cell[span]
    a = np.maximum(number * cell, lowest[span])  # windows a..b-1 of the cell are in the span
    b = np.minimum((number + 1) * cell, lowest[span] + windows[span])
    base = offsets[:-1][span] - lowest[span]  # text place of start 0
    core_a, core_b = base + number * cell + cell - 1, base + number * cell + length
    core = hashed(core_a, core_b)
    whole = hashed(base + a, base + b - 1 + length)
    key = mix64(core ^ mix64(group[span].astype(np.uint64) * _U(256) + number.astype(np.uint64)))
    order = np.lexsort((whole, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | ~_same_bytes(flat, core_a[order], core_b[order])
    sub = np.empty(len(order), dtype=np.int64)
    sub[order] = np.cumsum(new) - 1
    count = np.bincount(sub)[sub]
    twin = np.zeros(len(order), dtype=bool)
    same = ~new[1:] & (whole[order][1:] == whole[order][:-1]) & ((b - a)[order][1:] == (b - a)[order][:-1])
    same &= _same_bytes(flat, (base + a)[order], (base + b - 1 + length)[order], same)
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    twin_second = np.zeros(len(order), dtype=bool)
    twin_second[order[1:]] = same
    for k in np.flatnonzero(twin):  # equal in the whole cell
        s = first_window[span[k]] - lowest[span[k]]
        found[s + a[k] : s + b[k]] = True
    rest = np.flatnonzero((count > 1) & ~twin_second)  # one of equal ones stands for them
    rest = rest[np.argsort(sub[rest], kind="stable")]
    many = np.bincount(sub[rest], minlength=len(order))[sub[rest]] > 1
    rest = rest[many]
    # Suffix arrays of what is left, some hundred cells at a time, whole groups together.
    at = 0
    while at < len(rest):
        stop = min(len(rest), at + 4000)
        while stop < len(rest) and sub[rest[stop]] == sub[rest[stop - 1]]:
            stop += 1
        text: list[int] = []
        starts, owners = [], []
        for k in rest[at:stop].tolist():
            left = flat[base[k] + a[k] : core_a[k]]
            right = flat[core_b[k] : base[k] + b[k] - 1 + length]
            s = first_window[span[k]] - lowest[span[k]]
            starts.append(len(text) + np.arange(b[k] - a[k]))
            owners.append(s + np.arange(a[k], b[k]))
            text += [*(left.astype(np.int64) + 2).tolist(), 258 + int(sub[k]), *(right.astype(np.int64) + 2).tolist(), 1]
        text += [0]
        owner = np.full(len(text), -1, dtype=np.int64)
        owner[np.concatenate(starts)] = np.concatenate(owners)
        array = np.array(suffix_array(text))
        array = array[owner[array] >= 0]
        symbols = np.concatenate([np.array(text), np.zeros(cell, np.int64)])
        rows = symbols[array[:, None] + np.arange(cell)]
        equal = (rows[1:] == rows[:-1]).all(axis=1)
        found[owner[array[1:][equal]]] = True
        found[owner[array[:-1][equal]]] = True
        at = stop
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return a, b - a


def cells_of(part: bytes, anchor: int, run: int, length: int, piece: int, cell: int) -> Iterator[tuple[int, int, bytes]]:
    """A span cut into cells of windows: (hash of anchor, cell and core; run; bytes of the cell's windows).

    Equal windows lie in cells of one number and one core, so they share the hash.
    """
    hashes = piece_hashes(np.frombuffer(part, np.uint8), piece).view(np.int64)
    lowest = length - piece - int(np.argmax(hashes == anchor))
    first, windows = run >> 8, run & 255
    for number in range(lowest // cell, (lowest + windows - 1) // cell + 1):
        a, b = max(0, number * cell - lowest), min(windows, (number + 1) * cell - lowest)
        at = number * cell - lowest
        core = part[at + cell - 1 : at + length]
        deal = xxhash.xxh3_64_intdigest(core, (anchor + number * _ODD) % (1 << 64))
        yield deal - (1 << 63), (first + a) << 8 | (b - a), part[a : b - 1 + length]


class _Counters:
    """Counts of the most frequent values of a stream, each too low by at most total / ``most`` (Misra and Gries)."""

    def __init__(self, most: int):
        self.most, self.values, self.counts, self.total = most, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        self.total += len(values)
        new, n = np.unique(values, return_counts=True)
        both, at = np.unique(np.concatenate([self.values, new]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([self.counts, n])).astype(np.int64)
        if len(both) > self.most:
            counts -= np.partition(counts, len(both) - self.most - 1)[len(both) - self.most - 1]
        self.values, self.counts = both[counts > 0], counts[counts > 0]


Values = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _frequent(texts: DataFrame, values: Callable[[], Values], hot: int, most: int, name: str) -> np.ndarray:
    """The values (sorted) of texts, by a function made anew in each task, that occur more than about ``hot`` times, or more often than the ``most`` / 2-th part of all, if that is more.

    So there are at most ``most`` / 2 of them. Each task keeps ``most`` counters; they are added up by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = _Counters(most), values()
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                held.add(of(*text_bytes(part.column(0))))
        many = held.counts > 1  # a single one is hot in no task, and there are many
        yield pa.RecordBatch.from_arrays([pa.array([*held.values[many].tolist(), None], pa.int64()), pa.array([*held.counts[many].tolist(), held.total], pa.int64())], names=["value", "n"])

    counts = cut(texts.mapInArrow(run, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")), name)
    total = counts.where("value is null").agg(F.max("n")).first()[0] or 0
    got = counts.where(F.col("value").isNotNull() & (F.col("n") > max(hot, 2 * total // most))).select("value").toArrow()
    return np.sort(got.column("value").to_numpy())


def hot_anchors(texts: DataFrame, length: int, piece: int, hot: int, most: int = 100_000) -> np.ndarray:
    """Anchors that many spans have."""
    return _frequent(texts, lambda: lambda flat, offsets: spans_of(flat, offsets, length, piece)[3].view(np.int64), hot, most, "anchors")


def hot_cells(texts: DataFrame, crowded: np.ndarray, length: int, piece: int, cell: int, hot: int, most: int = 100_000) -> np.ndarray:
    """Routes of cells of the ``crowded`` anchors that many spans have: their texts share a passage somewhat shorter than a window. Equal spans of a task count once."""
    if not len(crowded):
        return crowded
    shared = texts.sparkSession.sparkContext.broadcast(crowded)

    def routes() -> Values:
        met: set[int] = set()

        def of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            doc, first, windows, anchor = spans_of(flat, offsets, length, piece)
            anchor = anchor.view(np.int64)
            at = np.flatnonzero(np.isin(anchor, shared.value))
            begin, raw, runs = (offsets[doc] + first).tolist(), flat.tobytes(), first << 8 | windows
            found = []
            for k in at.tolist():
                part = raw[begin[k] : begin[k] + int(windows[k]) + length - 1]
                name = xxhash.xxh3_64_intdigest(part)
                if name not in met:
                    if len(met) >= 200_000:
                        met.clear()
                    met.add(name)
                    found += [route for route, *_ in cells_of(part, int(anchor[k]), int(runs[k]), length, piece, cell)]
            return np.array(found, dtype=np.int64)

        return of

    return _frequent(texts, routes, hot, most, "cells")


def drop_repeats(docs: DataFrame, length: int = 200, piece: int = 64, hot: int = 2000, cell: int = 4) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): each text without the bytes that repeat.

    A byte goes if it lies in a window of ``length`` bytes that also starts anywhere else in the table, the same text
    included; windows are judged on the input. Texts are UTF-8 bytes (null: empty), ``kept`` are the bytes left, n_spans the
    maximal removed runs. Anchors that more than ``hot`` spans have are dealt out in cells of ``cell`` windows, and cells that more than
    ``hot`` spans have window by window. Each row is a
    text of its own: equal rows repeat each other, and rows that share an id are apart. Null ids and extra columns pass, an
    empty table gives no rows. Texts under ``length`` bytes stay whole.
    """
    if length - piece > 200:
        raise ValueError("length may exceed piece by 200 at most")
    # A text is named by two hashes and its length: equal texts lose the same bytes.
    body = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    body = body.withColumns({"key": F.xxhash64("text", F.octet_length("text")), "key2": F.xxhash64(F.lit(1), "text")})
    anchors = hot_anchors(body.select("text"), length, piece, hot)
    shared = docs.sparkSession.sparkContext.broadcast((anchors, frozenset(hot_cells(body.select("text"), anchors, length, piece, cell, hot).tolist())))
    names = ["route", "anchor", "d1", "d2", "key", "key2", "run", "known"]
    types = [*[pa.int64()] * 7, pa.bool_()]
    digest = xxhash.xxh3_128_intdigest
    low, mask = (1 << 63), (1 << 64) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, crowded_cells = shared.value
        met: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                flat, offsets = text_bytes(part.column(2))
                doc, first, windows, anchor = spans_of(flat, offsets, length, piece)
                if not len(doc):
                    continue
                raw = flat.tobytes()
                begin = offsets[doc] + first
                end = begin + windows + length - 1
                span = [digest(raw[x:y]) for x, y in zip(begin.tolist(), end.tolist())]
                anchor, run = anchor.view(np.int64), first << 8 | windows
                key, key2 = (part.column(c).to_numpy()[doc] for c in (0, 1))
                is_hot = np.isin(anchor, crowded) if len(crowded) else np.zeros(len(anchor), dtype=bool)
                d1, d2 = (np.array([f(x) for x in span], dtype=np.uint64).view(np.int64) for f in (lambda x: x >> 64, lambda x: x & mask))
                calm = ~is_hot
                yield pa.RecordBatch.from_arrays([pa.array(c[calm]) for c in (anchor, anchor, d1, d2, key, key2, run)] + [pa.array(np.zeros(int(calm.sum()), bool))], names=names)
                rows = []

                def goes_on(at: tuple[int, int], name: list[int], own: int) -> bool:
                    """Of equal spans, or windows, one goes on and stands for those met after it, which are repeated, as it is."""
                    before = met.get(at)
                    if before is None:
                        if len(met) >= 200_000:
                            met.clear()
                        met[at] = [*name, False]
                        return True
                    if not before[3]:
                        rows.append((before[0], own, 0, 0, *before[:3], True))
                        before[3] = True
                    if before[:3] != name:
                        rows.append((name[0], own, 0, 0, *name, True))
                    return False

                for k in np.flatnonzero(is_hot).tolist():
                    own, name = int(anchor[k]), [int(key[k]), int(key2[k]), int(run[k])]
                    if not goes_on((own, span[k]), name, own):
                        continue
                    for route, cell_run, text in cells_of(raw[begin[k] : end[k]], own, name[2], length, piece, cell):
                        if route not in crowded_cells:
                            d = digest(text)
                            rows.append((route, own, (d >> 64) - low, (d & mask) - low, *name[:2], cell_run, False))
                            continue
                        for i in range(cell_run & 255):  # windows that are equal share the route; there is nothing else in it
                            d = digest(text[i : i + length])
                            window = [*name[:2], ((cell_run >> 8) + i) << 8 | 1]
                            if goes_on((~own, d), window, own):
                                rows.append(((d & mask) - low, own, (d >> 64) - low, (d & mask) - low, *window, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    spans = body.select("key", "key2", "text").mapInArrow(scan, "route long, anchor long, d1 long, d2 long, key long, key2 long, run long, known boolean")
    # One pass over the spans of a route in order: alone or not, equal to a neighbour or not. Known ones have a route of their own text.
    near = Window.partitionBy("route").orderBy("known", "d1", "d2")
    twin = lambda f: F.coalesce((f("d1").over(near) == F.col("d1")) & (f("d2").over(near) == F.col("d2")) & ~F.col("known") & ~f("known").over(near), F.lit(False))
    other = lambda f: F.coalesce(~f("known").over(near), F.lit(False)) & ~F.col("known")
    marked = spans.select("*", (F.col("known") | other(F.lag) | other(F.lead)).alias("shared"), twin(F.lag).alias("like_before"), twin(F.lead).alias("like_after")).where("shared")
    marked = marked.withColumn("repeated", F.col("known") | F.col("like_before") | F.col("like_after"))
    marked = marked.withColumn("open", F.max(~F.col("repeated")).over(Window.partitionBy("route")))
    needed = F.col("open") & ~F.col("known") & ~F.col("like_before")  # one of each kind of span, where some are unlike
    marked = cut(marked.where(F.col("repeated") | needed).select(F.when(needed, F.col("route")).alias("route"), "anchor", "key", "key2", "run", "repeated"), "spans")
    whole = marked.where("repeated").select("key", "key2", "run")
    # The texts of the spans still open; of equal texts one.
    wanted = marked.where("route is not null").groupBy("key", "key2").agg(F.collect_list(F.struct("route", "anchor", "run", "repeated")).alias("runs"))
    pieces_of = lambda r: F.struct(
        r["route"].alias("route"), r["anchor"].alias("anchor"), r["run"].alias("run"), r["repeated"].alias("repeated"),
        F.call_function("substring", F.col("text"), (F.shiftright(r["run"], 8) + 1).cast("int"), (r["run"].bitwiseAND(F.lit(255)) + length - 1).cast("int")).alias("part"),
    )
    texts = body.select("key", "key2", "text").dropDuplicates(["key", "key2"]).join(wanted, ["key", "key2"]).select("key", "key2", F.explode(F.transform("runs", pieces_of)).alias("r"))
    texts = texts.select("key", "key2", "r.route", "r.anchor", "r.run", "r.repeated", "r.part")

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key, key2, route, anchor, run, repeated = (table.column(c).to_numpy() for c in ("key", "key2", "route", "anchor", "run", "repeated"))
        flat, offsets = text_bytes(table.column("part").chunk(0).cast(pa.binary()))
        group = np.cumsum(np.diff(route, prepend=route[:1]) != 0)
        windows = np.diff(offsets) - length + 1
        hashes = piece_hashes(flat, piece).view(np.int64)
        # The anchor stands where the hash is its own, the first such place in the span.
        hit = np.flatnonzero(hashes == np.repeat(anchor, np.diff(offsets))[: len(hashes)])
        lead = hit[np.searchsorted(hit, offsets[:-1])] - offsets[:-1]
        found = repeated_windows(flat, offsets, lead, group, length, piece)
        ends = np.cumsum(windows)
        out: tuple[list, list, list] = ([], [], [])
        for k in np.flatnonzero(~repeated):
            a, n = _runs(found[ends[k] - windows[k] : ends[k]])
            for x, c in zip(a.tolist(), n.tolist()):
                for column, value in zip(out, (key[k], key2[k], ((int(run[k]) >> 8) + x) << 8 | c)):
                    column.append(int(value))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "key2", "run"])

    settled = group_runs(texts, "route", settle, "key long, key2 long, run long")
    # Each copy of a text gave its spans: one of each stays, so a text's list is no longer than its own spans.
    removed = whole.union(settled).distinct().groupBy("key", "key2").agg(F.collect_list("run").alias("runs"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = []
                for raw, runs in zip(part.column(1).to_pylist(), part.column(2)):
                    kept, spans = raw, 0
                    if runs.is_valid:
                        run = runs.values.to_numpy()
                        a = run >> 8
                        mark = np.zeros(len(raw) + 1, dtype=np.int32)
                        np.add.at(mark, a, 1)
                        np.subtract.at(mark, a + (run & 255) + length - 1, 1)
                        gone = np.cumsum(mark[:-1]) > 0
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        spans = len(_runs(gone)[0])
                    rows.append((len(raw), len(raw) - len(kept), spans, kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = body.join(removed, ["key", "key2"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
