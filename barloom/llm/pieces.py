"""Operators 6 and 9: unigram encoding, decoding and counting over a double-array trie of pieces.

A piece vocabulary is read from a SentencePiece model file. Its whitespace marker stands for a space. Pieces of
a merge-based model carry merge ranks, not probabilities, so the log score of a piece of rank r is that of a
Zipf law, -ln(r+2) - ln Z, in whole micro-units: sums are exact, so ties are real ties. A tie keeps the longest
last piece. A character that is no piece by itself may be written as byte pieces, each ten units below the
rarest piece.

No piece has a space after another character, so a text splits exactly into chunks, each some spaces and the
characters up to the next space; each distinct chunk of a batch is segmented once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import ragged, scan_texts, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_LOW = np.int64(-(1 << 60))
_CHUNK = re.compile(r" +[^ ]*")
LONG = 64


class Pieces:
    """The vocabulary: bytes, micro-unit log scores, the double array and the byte pieces."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, dtype=np.int32)
        ranked = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                ranked.append((-sp.get_score(i), i))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        ranked.sort()
        raw = -np.log(np.arange(len(ranked)) + 2.0)
        raw -= np.log(np.exp(raw).sum())
        micro = np.rint(raw * 1e6).astype(np.int64)
        self.score = np.zeros(n, dtype=np.int64)
        self.score[[i for _, i in ranked]] = micro
        self.byte_score = int(micro[-1]) - 10_000_000
        if any(re.search(rb"[^ ] ", self.bytes[i]) for _, i in ranked):
            raise ValueError("a piece has a space inside: texts can't be split at spaces")
        self._double_array({self.bytes[i]: i for _, i in ranked})
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def _double_array(self, entries: dict[bytes, int]) -> None:
        """base[s]+c is the slot of the child of s by byte c, if check[] of the slot is s; value is the piece or -1."""
        tree: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, i in entries.items():
            node = 0
            for c in word:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                    ends.append(-1)
                node = tree[node][c]
            ends[node] = i
        size = 8 * len(tree) + 4096
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = np.zeros(size, dtype=bool)
        taken[0] = True
        slot = {0: 0}
        order, at = [0], 0
        while at < len(order):
            order.extend(tree[order[at]].values())
            at += 1
        # Branching nodes look for room from the last find on; nodes with one child fill the holes.
        free, room = 1, 1
        for node in order:
            kids = tree[node]
            here = slot[node]
            value[here] = ends[node]
            if not kids:
                continue
            codes = np.fromiter(kids, np.int64)
            if len(codes) == 1:
                while taken[free] or free <= codes[0]:
                    free += 1
                b = free - int(codes[0])
            else:
                b = room
                while True:
                    fits = ~taken[np.arange(b, b + 512)[:, None] + codes].any(axis=1)
                    if fits.any():
                        b += int(fits.argmax())
                        break
                    b += 512
                room = max(room, b - 256)
            base[here] = b
            for c, kid in kids.items():
                taken[b + c], check[b + c], slot[kid] = True, here, b + c
        used = int(np.flatnonzero(taken)[-1]) + 257
        self.base, self.check, self.value = base[:used], check[:used], value[:used]

    # ---- one chunk after the other: used for few long chunks, and in tests ----

    def segment(self, chunk: bytes) -> list[int]:
        """The best pieces of one chunk, by Viterbi over the double array."""
        n = len(chunk)
        best, back = [int(_LOW)] * (n + 1), [None] * (n + 1)
        best[0] = 0
        base, check, value, score = self.base, self.check, self.value, self.score
        for s in range(n):
            if best[s] == _LOW:
                continue
            width = _width(chunk[s])
            single, state, pos = False, 0, s
            while pos < n:
                t = int(base[state]) + chunk[pos]
                if check[t] != state:
                    break
                state, pos = t, pos + 1
                if value[state] >= 0:
                    single |= pos == s + width
                    got = best[s] + int(score[value[state]])
                    if got > best[pos]:
                        best[pos], back[pos] = got, (s, int(value[state]))
            if not single:
                pos = min(n, s + width)
                got = best[s] + self.byte_score * (pos - s)
                if got > best[pos]:
                    best[pos], back[pos] = got, (s, -1)
        out, pos = [], n
        while pos:
            s, piece = back[pos]
            out.extend([piece] if piece >= 0 else self.byte_id[np.frombuffer(chunk[s:pos], np.uint8)[::-1]].tolist())
            pos = s
        return out[::-1]

    # ---- all distinct chunks of a batch at once ----

    def segment_all(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all chunks (bytes in ``flat``, cut at ``offsets``): the pieces in a row, and the count of each chunk."""
        sizes = np.diff(offsets)
        counts = np.zeros(len(sizes), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (chunk numbers repeated, pieces), in order inside a chunk
        low = 0
        for high in (8, 12, 16, 24, 32, 64):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) // 60_000)) if len(rows) else []:
                found.append(self._lattice(flat, offsets, part, high, counts))
        for row in np.flatnonzero(sizes > low):
            got = self.segment(flat[offsets[row] : offsets[row + 1]].tobytes())
            counts[row] = len(got)
            found.append((np.full(len(got), row), np.array(got, dtype=np.int32)))
        if not found:
            return np.zeros(0, np.int32), counts
        owner = np.concatenate([f[0] for f in found])
        pieces = np.concatenate([f[1] for f in found])
        return pieces[np.argsort(owner, kind="stable")], counts

    def _lattice(self, flat, offsets, rows, width, counts):
        n = len(rows)
        sizes = offsets[rows + 1] - offsets[rows]
        chars = np.zeros((width, n), dtype=np.int32)
        cell = ragged(np.zeros(n, np.int64), sizes)
        chars[cell, np.repeat(np.arange(n), sizes)] = flat[ragged(offsets[rows], sizes)]
        best = np.full((width + 1, n), _LOW)
        best[0] = 0
        came = np.zeros((width + 1, n), dtype=np.int32)
        piece = np.full((width + 1, n), -1, dtype=np.int32)
        for s in range(width):
            live = np.flatnonzero((best[s] > _LOW) & (sizes > s))
            if not len(live):
                continue
            start_best, state = best[s, live], np.zeros(len(live), dtype=np.int32)
            need = _WIDTHS[chars[s, live]]
            alone = np.ones(len(live), dtype=bool)  # no single-character piece seen
            who = np.arange(len(live))
            for pos in range(s, width):
                t = self.base[state] + chars[pos, live[who]]
                ok = (self.check[t] == state) & (sizes[live[who]] > pos)
                who, state = who[ok], t[ok]
                if not len(who):
                    break
                v = self.value[state]
                hit = v >= 0
                w, v = who[hit], v[hit]
                alone[w[need[w] == pos + 1 - s]] = False
                got, col = start_best[w] + self.score[v], live[w]
                better = got > best[pos + 1, col]
                col = col[better]
                best[pos + 1, col], came[pos + 1, col], piece[pos + 1, col] = got[better], s, v[better]
            w = np.flatnonzero(alone)
            if len(w):
                to = np.minimum(s + need[w], sizes[live[w]])
                got, col = start_best[w] + self.byte_score * (to - s), live[w]
                better = got > best[to, col]
                col, to = col[better], to[better]
                best[to, col], came[to, col], piece[to, col] = got[better], s, -1
        # Walk back from each end in step; a fallback gives one piece a byte.
        pos, col, steps = sizes.copy(), np.arange(n), []
        while len(col):
            p, s = piece[pos, col], came[pos, col]
            plain = p >= 0
            steps.append((col[plain], s[plain], p[plain]))
            if not plain.all():
                c, a, span = col[~plain], s[~plain], pos[~plain] - s[~plain]
                at = ragged(a.astype(np.int64), span)
                c = np.repeat(c, span)
                steps.append((c, at, self.byte_id[chars[at, c]]))
            more = s > 0
            pos, col = s[more].astype(np.int64), col[more]
        col, at, p = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((at, col))
        counts[rows] += np.bincount(col, minlength=n)
        return rows[col[order]], p[order].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of pieces: bytes in a row, markers as spaces, without the space put in front."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")[1:]

    # ---- counting over a trie of pre-tokens ----

    def count_all(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of each chunk, from a trie of all chunks: a forward score once for each shared prefix.

        Chunks of more than ``LONG`` bytes are few and share little; their trie is walked branch by branch.
        Level by level, each node holds its best score and piece count. Open walks (start node, state of the double
        array) go down the trie with the node they are at; where a walk stands on a piece, the node may take it.
        """
        sizes = np.diff(offsets)
        counts = np.zeros(len(sizes), dtype=np.int64)
        long = np.flatnonzero(sizes > LONG)
        counts[long] = self._count_long([flat[offsets[k] : offsets[k + 1]].tobytes() for k in long.tolist()])
        short = np.flatnonzero(sizes <= LONG)
        n = len(short)
        if not n:
            return counts
        order = short[_byte_order(flat, offsets[:-1][short], sizes[short])]
        begin, size = offsets[:-1][order], sizes[order]
        node = np.zeros(n, dtype=np.int64)  # of each chunk still open, at this depth
        open_rows = np.arange(n)
        best, pieces = np.zeros(1, np.int64), np.zeros(1, np.int64)
        done = open_rows[size == 0]
        # Walks, grouped by node: where they stand, state (-1: dead), start depth, score and count at the start, bytes of the first character.
        walk = {k: np.zeros(0, np.int64) for k in ("node", "state", "start", "score", "count", "need", "alone")}
        depth = 0
        while True:
            keep = size[open_rows] > depth
            # Reachable nodes begin a walk.
            from_here = np.flatnonzero(best > _LOW)
            fresh = {"node": from_here, "state": np.zeros_like(from_here), "start": np.full_like(from_here, depth), "score": best[from_here], "count": pieces[from_here], "need": np.zeros_like(from_here), "alone": np.ones_like(from_here)}
            walk = {k: np.concatenate([walk[k], fresh[k]]) for k in walk}
            open_rows, node = open_rows[keep], node[keep]
            if not len(open_rows):
                break
            # Children: neighbours in byte order that share more than depth bytes are one node.
            byte = flat[begin[open_rows] + depth].astype(np.int64)
            new = np.ones(len(open_rows), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])
            child = np.cumsum(new) - 1
            parent, edge = node[new], byte[new]
            # Each walk goes on to each child of its node.
            by_node = np.argsort(walk["node"], kind="stable")
            walk = {k: v[by_node] for k, v in walk.items()}
            per = np.bincount(walk["node"], minlength=len(best))
            first = np.cumsum(per) - per
            pick = ragged(first[parent], per[parent])
            at = np.repeat(np.arange(len(parent)), per[parent])
            walk = {k: v[pick] for k, v in walk.items()}
            walk["node"] = at
            c = edge[at]
            fresh_one = walk["start"] == depth
            walk["need"] = np.where(fresh_one, _WIDTHS[c], walk["need"])
            t = np.where(walk["state"] >= 0, self.base[np.maximum(walk["state"], 0)] + c, 0)
            walk["state"] = np.where((walk["state"] >= 0) & (self.check[t] == walk["state"]), t, -1).astype(np.int64)
            depth += 1
            value = np.where(walk["state"] >= 0, self.value[np.maximum(walk["state"], 0)], -1)
            at_char = depth - walk["start"] == walk["need"]
            spelled = at_char & (value < 0)
            got = np.where(value >= 0, walk["score"] + self.score[np.maximum(value, 0)], np.where(spelled, walk["score"] + self.byte_score * walk["need"], _LOW))
            more = walk["count"] + np.where(value >= 0, 1, walk["need"])
            # The best walk of each node; the first start wins a tie, so the last piece is the longest.
            best, pieces = np.full(len(parent), _LOW), np.zeros(len(parent), np.int64)
            hit = np.flatnonzero(got > _LOW)
            if len(hit):
                rank = hit[np.lexsort((walk["start"][hit], -got[hit], walk["node"][hit]))]
                lead = np.ones(len(rank), dtype=bool)
                lead[1:] = walk["node"][rank][1:] != walk["node"][rank][:-1]
                rank = rank[lead]
                best[walk["node"][rank]], pieces[walk["node"][rank]] = got[rank], more[rank]
            alive = (walk["state"] >= 0) | (depth - walk["start"] < walk["need"])
            walk = {k: v[alive] for k, v in walk.items()}
            node = child
            done = np.flatnonzero(size[open_rows] == depth)
            counts[order[open_rows[done]]] = pieces[node[done]]
        return counts

    def _count_long(self, chunks: list[bytes]) -> list[int]:
        """The same for long chunks. In byte order, a chunk goes on from the scores at the end of what it shares with the one before."""
        out, before = [0] * len(chunks), b""
        best, count = [0], [0]
        base, check, value, score, low = self.base, self.check, self.value, self.score, int(_LOW)
        most = max(4, int(self.lengths.max()))
        for k in sorted(range(len(chunks)), key=chunks.__getitem__):
            chunk = chunks[k]
            n, shared = len(chunk), _shared(before, chunk)
            best[shared + 1 :], count[shared + 1 :] = [low] * (n - shared), [0] * (n - shared)
            for s in range(max(0, shared + 1 - most), n):
                if best[s] == low:
                    continue
                width = int(_WIDTHS[chunk[s]])
                single, state, pos = False, 0, s
                while pos < n:
                    t = int(base[state]) + chunk[pos]
                    if check[t] != state:
                        break
                    state, pos = t, pos + 1
                    if value[state] >= 0:
                        single |= pos == s + width
                        got = best[s] + int(score[value[state]])
                        if pos > shared and got > best[pos]:
                            best[pos], count[pos] = got, count[s] + 1
                if not single:
                    pos = min(n, s + width)
                    got = best[s] + self.byte_score * (pos - s)
                    if pos > shared and got > best[pos]:
                        best[pos], count[pos] = got, count[s] + pos - s
            out[k], before = count[n], chunk
        return out


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two strings share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


_WIDTHS = np.ones(256, dtype=np.int64)
_WIDTHS[0xC0:0xE0], _WIDTHS[0xE0:0xF0], _WIDTHS[0xF0:] = 2, 3, 4


def _width(lead: int) -> int:
    return int(_WIDTHS[lead])


def _byte_order(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of short byte strings, shorter first among equal prefixes: eight bytes at a time, from the last on."""
    n = len(sizes)
    keys = [sizes]
    for block in range((int(sizes.max(initial=0)) + 7) // 8 - 1, -1, -1):
        word = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            at = 8 * block + k
            inside = sizes > at
            byte = np.zeros(n, dtype=np.uint64)
            byte[inside] = flat[begin[inside] + at]
            word = (word << np.uint64(8)) | byte
        keys.append(word)
    return np.lexsort(keys)


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, each without its first space, and the n+1 offsets of the texts among them."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten()
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not blank.any():
        return words, offsets
    # Runs of spaces: those texts are cut by the pattern of a chunk.
    mixed = np.add.reduceat(blank, offsets[:-1]) > 0
    lists = split.to_pylist()
    for i in np.flatnonzero(mixed):
        lists[i] = [c[1:] for c in _CHUNK.findall(" " + texts[int(i)].as_py())]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return pa.array([w for x in lists for w in x], pa.string()), np.concatenate([[0], np.cumsum(sizes)])


def distinct_chunks(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its number among the distinct ones; bytes and offsets of those, each with a space in front."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    flat, offsets = text_bytes(pc.binary_join_element_wise(pa.scalar(""), coded.dictionary, " "))
    return coded.indices.to_numpy(), flat, offsets


def load(spark: SparkSession, model: str = MODEL) -> Broadcast:
    """The vocabulary for the executors (its size is that of the model file, whatever the input)."""
    return spark.sparkContext.broadcast(Pieces(model))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Operator 6. Rows (doc_id, n_pieces, round_trip, ids): the pieces of the whole text, and whether decoding gives it back.

    Null texts count as empty; an empty text is one space piece, as a space goes in front of every text. A marker
    character of the text itself is spelled in bytes, so it comes back. Null ids, repeated rows and extra columns
    pass row by row; an empty table gives no rows.
    """
    shared = load(docs.sparkSession, model)

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        ids, texts = columns
        words, ends = chunks(texts)
        number, flat, offsets = distinct_chunks(words)
        found, counts = pieces.segment_all(flat, offsets)
        first = np.cumsum(counts) - counts
        per_word = counts[number]
        out = found[ragged(first[number], per_word)]
        cuts = np.concatenate([[0], np.cumsum(per_word)])[ends]
        # Decode: the bytes of the pieces in a row, against the bytes of the texts with a space in front.
        size = pieces.lengths[out]
        back = pieces.flat[ragged(pieces.starts[out], size)]
        back_ends = np.concatenate([[0], np.cumsum(size)])[cuts]
        want, want_ends = text_bytes(texts)
        same = np.diff(back_ends) - 1 == np.diff(want_ends)
        if same.all():
            body = np.ones(len(back), dtype=bool)
            body[back_ends[:-1]] = False
            differ = np.concatenate([[0], np.cumsum(back[body] != want)])
            same &= (np.diff(differ[want_ends]) == 0) & (back[back_ends[:-1]] == 32)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(cuts), pa.int64()), pa.array(same), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out, pa.int32()))],
            names=["doc_id", "n_pieces", "round_trip", "ids"],
        )

    return scan_texts(docs, fn, "doc_id long, n_pieces long, round_trip boolean, ids array<int>", max_bytes=2 << 20)


def count(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Operator 9. Rows (doc_id, n_tokens, n_pretokens): unigram token counts, each from the trie of a batch's distinct chunks.

    The counts are those of ``encode``. Null texts count as empty (one token: the space in front); null ids, repeated
    rows and extra columns pass row by row; an empty table gives no rows.
    """
    shared = load(docs.sparkSession, model)

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        ids, texts = columns
        words, ends = chunks(texts)
        number, flat, offsets = distinct_chunks(words)
        terminal = pieces.count_all(flat, offsets)
        total = np.concatenate([[0], np.cumsum(terminal[number])])[ends]
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(total), pa.int64()), pa.array(np.diff(ends), pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return scan_texts(docs, fn, "doc_id long, n_tokens long, n_pretokens long", max_bytes=8 << 20)
