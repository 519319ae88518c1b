"""Operator 5: personal data, by patterns and by a linear-chain conditional random field over word shapes.

The patterns find emails, IP addresses, card numbers and phone numbers. The field labels the words of each text with
O or the begin and inside of the same kinds, from the shapes of a word and its neighbours; it is trained here from a
small labelled table and decoded by Viterbi over many lines at once. Its spans are added where the field itself gives them
a probability of a half or more, they hold what their kind can't be without, and they meet no span of the patterns;
pattern spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import scan_texts, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])

# The patterns. Those of emails and addresses are tried only where a match can begin (see below), so that a
# text takes time in proportion to its length.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of local part, @ and domain. A local part reaches up to its @, so each whole run of its characters is tried once."""
    free = 0
    for run in _LOCAL.finditer(text):
        begin, end = max(free, run.start()), run.end()
        if begin < end and text.startswith("@", end) and (domain := _DOMAIN.match(text, end + 1)):
            free = domain.end()
            yield begin, free


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The matches of four numbers joined by dots: each chain of numbers is cut into fours."""
    for chain in _NUMBERS.finditer(text):
        numbers = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start; kinds may overlap each other."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    if _DIGIT.search(text):
        out += [(1, *span) for span in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The labelled table: a line of words, each of personal data marked {kind:words}. Some spell what the patterns miss.
LABELLED = (
    "please write to {email:anna.smith@mail.example.org} before noon",
    "contact {email:bob at example dot com} for the files",
    "reach me: {email:carla [at] post [dot] example [dot] net} or call",
    "mail {email:d.jones(at)example.com} today",
    "her address is {email:eva at mail dot example dot org}",
    "we met at the corner and then at noon in town",
    "at home there is a dot on the map at the right",
    "the dot com years were at an end",
    "host {ip:10.20.30.40} did not answer",
    "the server at {ip:192.168.7.15} is down, {ip:172.16.0.9} is up",
    "from {ip:8.8.4.4} to {ip:9.9.9.9}",
    "version 10.2 of the tool came after 9.1",
    "card {card:4539 1488 0343 6467} was refused",
    "pay with {card:4539148803436467} or cash",
    "number {card:5500-0000-0000-0004} on file",
    "there were 4539 people in 1488 towns",
    "call {phone:(555) 123-4567} after six",
    "phone {phone:555-123-4567} or {phone:555.987.6543}",
    "tel {phone:+1 (743) 555-3824} for more",
    "dial {phone:+49 30 901820} now",
    "her number is {phone:(020) 555-0199} at work",
    "it cost 1250 in 2019 and 1300 in 2020",
    "pages 12-15 and 20-25 of volume 3",
    "on 12.05.2021 at 10:30 they left",
    "the table has 3 | 4 | 5 and 6",
    "see section 4.2.1 and 7.3 of the text",
    "THE RATE!! WAS!! 25!! OF!! 100!!",
    "le train de 8 heures et la gare de 1900",
    "der preis von 12,50 und die zahl 300",
    "en el año 1998 y la calle 25",
    "token = 1eb9c654e721b4f8 was found",
    "the cat sat on the mat and slept",
    "und die katze la casa que le chat",
    "a b c d e f g h",
    "ask {email:frank (at) post (dot) org} or {email:gina at example dot com} about it",
    "write {email:hans at post dot net} or {email:ida at example dot com}",
    "{email:joe_king [at] mail [dot] org} is the one to ask",
    "send it to {email:k.lee(at)post.example.net} and wait",
    "the box {ip:10 dot 20 dot 30 dot 40} is behind the door",
    "ping {ip:192 dot 168 dot 0 dot 1} first",
    "card {card:3782 822463 10005} expires soon",
    "charge {card:4111.1111.1111.1111} with 20 euros",
    "phone {phone:030 901820} in the morning",
    "call {phone:555 123 4567} before noon",
    "ring {phone:0171-5550199} or {phone:(0171) 555-0199}",
    "tel {phone:020 7946 0958} at night",
    "call us at {phone:800 555 0199} today",
    "phone {phone:089/5551234} for a room",
    "they sat at the dot and looked at me",
    "look at 5 of them at 10 or at noon",
    "from 1990 to 2005 there were 30 000 people",
    "we sold 120 000 of them for 15 000 euros",
    "open at 9:00 and shut at 17:30 on 24.12.2020",
    "isbn 978-3-16-148410-0 is a book",
    "order 2021-000123 was sent on 2021-05-12",
    "the score was 3-2 and then 21-19 at home",
    "chapter 10.2.3.4.5 of the manual",
    "figures 1 2 3 4 5 6 7 8 9 10 in a row",
    "row 100 200 300 400 500 of the table",
    "key = 9f86d081884c7d659a2feaa0c55ad015 was lost",
    "it is 3.14 or 2.718 and not 1.5",
    "on page 25 at line 30 there is a dot",
    "in 2019 2020 and 2021 at 10 per cent",
    "he looked at the dot of light at the end",
    "we wait at the dot of the hour at ten",
    "{email:anna at web dot org} said at noon that {email:hans at mail dot net} left",
    "then {email:uwe at web dot org} wrote at ten to {email:lea at mail dot net} at home",
    "is {email:max [at] post [dot] mail [dot] org} or {email:tom(at)mail.net} right",
    "fax {phone:(030) 555-0177} and mail {email:pia(at)example.org} please",
)


def _words(line: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for kind, inner, plain in re.findall(r"\{(\w+):([^}]*)\}|([^{}]+)", line):
        for k, w in enumerate((inner or plain).split()):
            words.append(w)
            labels.append(LABELS.index(f"{'I' if k else 'B'}-{kind}") if kind else 0)
    return words, labels


_RUNS = re.compile(r"(.)\1{4,}")
_INNER = re.compile(r"(?<=\w)[(\[]at[)\]](?=\w)")
_SIGNS = frozenset(("at", "dot", "[at]", "[dot]", "(at)", "(dot)"))
_KEPT = _SIGNS | {"the", "a", "of", "in", "and", "or", "is", "was"}


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, other characters as they are; runs over four are cut to four.

    The two words that stand for signs in spelled-out addresses, and some that never are names in one, keep their spelling;
    an at in brackets inside a word is the sign itself.
    """
    if word in _KEPT:
        return word
    return _shape_of(_INNER.sub("@", word).translate(_SHAPES))


class _Shapes(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        out = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch if c < 128 else "?"
        if len(self) < 10_000:
            self[c] = out
        return out


_SHAPES = _Shapes()


def _shape_of(s: str) -> str:
    return _RUNS.sub(lambda m: m[1] * 4, s)


def features(s: str) -> list[str]:
    """What the field sees of one shape."""
    bare = s.strip(".,;:!?\"'*#$%&|")
    digits = bare.count("9")
    return [
        f"shape={bare if digits or '@' in bare or bare in _KEPT else 'word' if bare else 'sign'}",
        f"digits={min(digits, 5)}",
        f"signs={''.join(sorted(set(c for c in bare if c in '@.-+()[]')))}" if digits or "@" in bare else "signs=",
        f"alpha={'x' in bare or 'X' in bare}",
        f"caps={'X' in bare}",
    ]


REACH = (-2, -1, 0, 1, 2)


class Field:
    """Weights: a table of label scores for each feature of the shapes two words back to two ahead (``REACH``), and label changes."""

    def __init__(self, emissions: dict[str, np.ndarray], steps: np.ndarray, start: np.ndarray):
        self.emissions, self.steps, self.start = emissions, steps, start
        self.cache: dict[str, np.ndarray] = {}

    def score(self, s: str) -> np.ndarray:
        """Label scores that a shape gives to the words around it, one row an offset of ``REACH``."""
        got = self.cache.get(s)
        if got is None:
            zero = np.zeros(len(LABELS))
            names = features(s)
            got = np.stack([sum((self.emissions.get(f"{at}{n}", zero) for n in names), zero) for at in REACH])
            if len(self.cache) < 100_000 and len(s) < 100:
                self.cache[s] = got
        return got

    def scores(self, shapes: list[str], chunk: int = 4096) -> np.ndarray:
        """One row of label scores a word of a line."""
        n, far = len(shapes), max(REACH)
        out = np.zeros((n, len(LABELS)))
        for first in range(0, n, chunk):
            begin, stop = max(0, first - far), min(n, first + chunk + far)
            parts = np.stack([self.score(s) for s in shapes[begin:stop]], axis=1)
            for at, part in zip(REACH, parts):  # the shape at k + at scores the word at k
                low, high = max(first, -at), min(first + chunk, n, n - at)
                if low < high:
                    out[low:high] += part[low + at - begin : high + at - begin]
        return out


def _allowed() -> np.ndarray:
    """Label changes that can't be: inside a kind only after that kind."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:] or a == "O":
                    bad[i, j] = -1e4
    return bad


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(table: tuple[str, ...] = LABELLED, epochs: int = 150, rate: float = 0.3, decay: float = 0.002) -> Field:
    """Fit the field by gradient steps on the likelihood of the labelled lines (forward and backward sums).

    The table is small and given, so this runs where it is called, in a second or two.
    """
    lines = [_words(t) for t in table]
    shapes = [[shape(w) for w in words] for words, _ in lines]
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f"{at}{f}", len(names)) for at in REACH if 0 <= k + at < len(line) for f in features(line[k + at])] for k in range(len(line))] for line in shapes]
    n, size, longest = len(LABELS), len(lines), max(map(len, shapes))
    # All lines at once: features of each word (filled up by one that weighs nothing), true labels, and which words there are.
    held = np.full((size, longest, max(len(f) for row in rows for f in row)), len(names))
    gold, real = np.zeros((size, longest, n)), np.zeros((size, longest), dtype=bool)
    for j, (row, (_, labels)) in enumerate(zip(rows, lines)):
        real[j, : len(row)] = True
        gold[j, np.arange(len(row)), labels] = 1
        for k, f in enumerate(row):
            held[j, k, : len(f)] = f
    last = real.sum(axis=1) - 1
    true_steps = np.einsum("jka,jkb->ab", gold[:, :-1], gold[:, 1:])
    weights, steps, start = np.zeros((len(names) + 1, n)), np.zeros((n, n)), np.zeros(n)
    bad = _allowed()
    no_start = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])
    past = [np.full_like(weights, 1e-2), np.full_like(steps, 1e-2), np.full_like(start, 1e-2)]
    for _ in range(epochs):
        e, move = weights[held].sum(axis=2), steps + bad
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = start + no_start + e[:, 0]
        for k in range(1, longest):
            a[:, k] = _logsum(a[:, k - 1, :, None] + move, 1) + e[:, k]
        for k in range(longest - 2, -1, -1):
            b[:, k] = np.where(real[:, k + 1, None], _logsum(move + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        total = _logsum(a[np.arange(size), last], 1)[:, None, None]
        miss = np.where(real[:, :, None], gold - np.exp(np.minimum(a + b - total, 0)), 0)
        pairs = np.exp(np.minimum(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[..., None], 0))
        grads = [-decay * weights, -decay * steps + true_steps - (pairs * real[:, 1:, None, None]).sum(axis=(0, 1)), -decay * start + miss[:, 0].sum(axis=0)]
        np.add.at(grads[0], held, miss[:, :, None, :])
        grads[0][-1] = 0
        for value, grad, square in zip((weights, steps, start), grads, past):
            square += grad * grad
            value += rate * grad / np.sqrt(square)
    return Field({f: weights[k] for f, k in names.items()}, steps + bad, start + no_start)


SEGMENT = 256
_NEVER = -1e30


class _Segments:
    """Many lines, cut into segments of up to ``SEGMENT`` words that are computed side by side, one array step a word.

    What a segment makes of each label it may be entered with is a matrix; those of a long line are folded in order, and tell
    each of its segments what comes before and after. So time and memory follow the words of all lines, whatever their lengths.
    ``add`` is the sum over paths: the greatest for the best labels, the log of the sum for probabilities.
    """

    def __init__(self, scores: list[np.ndarray], field: Field, add: Callable[[np.ndarray, int], np.ndarray]) -> None:
        self.scores, self.field, self.add = scores, field, add
        spans = [(k, a, min(a + SEGMENT, len(x))) for k, x in enumerate(scores) for a in range(0, len(x), SEGMENT)]
        self.spans = spans
        self.goes_on = np.array([b < len(scores[k]) for k, _, b in spans], dtype=bool)
        self.follows = np.array([a > 0 for _, a, _ in spans], dtype=bool)
        self.enter = np.tile(field.start, (len(spans), 1))
        self.end = np.zeros((len(spans), len(LABELS)))
        self._fold()

    def groups(self, wanted: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Wanted segments by falling length: their numbers, how many are left at each word, and their scores (word, segment, label)."""
        sizes = np.array([b - a for _, a, b in self.spans], dtype=np.int64)
        order = wanted[np.argsort(-sizes[wanted], kind="stable")]
        start = 0
        while start < len(order):
            longest = int(sizes[order[start]])
            group = order[start : start + max(1, most // longest)]
            start += len(group)
            table = np.zeros((longest, len(group), len(LABELS)))
            for j, s in enumerate(group.tolist()):
                k, a, b = self.spans[s]
                table[: b - a, j] = self.scores[k][a:b]
            yield group, np.searchsorted(-sizes[group], -np.arange(longest), "left"), table

    def _fold(self) -> None:
        long = np.flatnonzero(self.goes_on | self.follows)
        if not len(long):
            return
        n, steps, add = len(LABELS), self.field.steps, self.add
        through = np.empty((len(self.spans), n, n))  # from the label of the first word to that of the next segment's first
        whole = np.empty((len(self.spans), n))
        for group, live, table in self.groups(long, 1 << 14):
            now = np.where(np.eye(n, dtype=bool), 0.0, _NEVER)[None] + table[0][:, None, :]
            for t in range(1, len(table)):
                now[: live[t]] = add(now[: live[t], :, :, None] + steps, 2) + table[t, : live[t], None, :]
            whole[group] = add(now, 2)
            through[group] = add(now[..., None] + steps, 2)
        for s in long.tolist():
            if self.follows[s]:
                self.enter[s] = add(self.enter[s - 1][:, None] + through[s - 1], 0)
        after = np.empty((len(self.spans), n))
        for s in long[::-1].tolist():
            after[s] = add(through[s] + after[s + 1], 1) if self.goes_on[s] else whole[s]
            if self.goes_on[s]:
                self.end[s] = add(steps + after[s + 1], 1)


def viterbi(scores: list[np.ndarray], field: Field) -> list[np.ndarray]:
    """The best labels of many lines at once."""
    cut = _Segments(scores, field, lambda x, axis: x.max(axis=axis))
    count, n = len(cut.spans), len(LABELS)
    last = np.empty((count, n))
    paths: list[np.ndarray] = [np.zeros((0, n), np.int8)] * count
    for group, live, table in cut.groups(np.arange(count)):
        best = cut.enter[group] + table[0]
        back = np.zeros(table.shape, dtype=np.int8)
        for t in range(1, len(table)):
            reach = best[: live[t], :, None] + field.steps
            back[t, : live[t]] = reach.argmax(axis=1)
            best[: live[t]] = reach.max(axis=1) + table[t, : live[t]]
        # The path to each label that the segment may end with.
        now = np.tile(np.arange(n, dtype=np.int8), (len(group), 1))
        path = np.zeros(table.shape, dtype=np.int8)
        for t in range(len(table) - 1, -1, -1):
            path[t, : live[t]] = now[: live[t]]
            now[: live[t]] = np.take_along_axis(back[t, : live[t]], now[: live[t]].astype(np.int64), 1)
        last[group] = best
        for j, s in enumerate(group.tolist()):
            paths[s] = path[: cut.spans[s][2] - cut.spans[s][1], j]
    out = [np.zeros(len(x), np.int64) for x in scores]
    for s in range(count - 1, -1, -1):
        k, a, b = cut.spans[s]
        label = int((last[s] + field.steps[:, out[k][b]] if cut.goes_on[s] else last[s]).argmax())
        out[k][a:b] = paths[s][:, label]
    return out


_WORD = re.compile(r"\S+")
# A word that can begin or continue a span: it has a digit or sign of one, or is one of the spelled signs.
_MARK = re.compile(r"[0-9@]|(?<!\S)[\[(]?(?:at|dot)[\])]?(?!\S)|\((?:at|dot)\)")
_EDGE = ".,;:!?\"'*#$%&|"


def lines_of(text: str, reach: int = 4) -> Iterator[list[tuple[int, int]]]:
    """The stretches of words the field has to label: all words within ``reach`` words of a word with a mark.

    Far from marks all words look alike to the field and are labelled O, so decoding those gives nothing.
    """
    marks = [m.start() for m in _MARK.finditer(text)]
    if not marks:
        return
    words = [m.span() for m in _WORD.finditer(text)]
    at = np.unique(np.searchsorted(np.array([a for a, _ in words]), marks, "right") - 1)
    first = np.flatnonzero(np.diff(at, prepend=-2 * reach - 9) > 2 * reach + 1)
    for a, b in zip(at[first].tolist(), at[np.append(first[1:], len(at)) - 1].tolist()):
        yield words[max(0, a - reach) : b + reach + 1]


# The two signs as they are spelled, with what is no word around them; then a name, a dot, a name.
_SPELLED_AT = re.compile(r"(?<!\W)\W*(?:@|\bat\b)\W*|(?<=\W)@\W*", re.ASCII)
_SPELLED_DOT = re.compile(r"(?<!\W)\W*\bdot\b\W*", re.ASCII)
_NAME = re.compile(r"[\w.%+-]*\w", re.ASCII)
_HOST = re.compile(r"[\w-]++[^\w.]*+\.\W*+\w\w", re.ASCII)
_NUMBER = re.compile(r"[0-9]+")


def _holds(kind: int, part: str) -> bool:
    """Whether a span has what its kind can't be without: an at before a dot, four bytes, a card's check digit, digits enough."""
    digits = sum("0" <= c <= "9" for c in part)
    if kind == 0:
        name, at, host = _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", part)).partition("@")
        return bool(at and _NAME.fullmatch(name) and _HOST.match(host))
    if kind == 1:
        numbers = _NUMBER.findall(part)
        return len(numbers) == 4 and all(map(_byte, numbers))
    if kind == 2:
        return 12 <= digits <= 19 and luhn("".join(_NUMBER.findall(part)))
    return 7 <= digits <= 15


def span_probabilities(scores: list[np.ndarray], labels: list[np.ndarray], spans: list[tuple[int, int, int]], field: Field) -> list[float]:
    """The field's probability of each span (line, first, stop): that just these words of the line are the span that ``labels`` make of them.

    The sums over all ways before and after a word are taken once a line, and serve all of its spans.
    """
    lines = sorted({k for k, _, _ in spans})
    at_line = {k: j for j, k in enumerate(lines)}
    cut = _Segments([scores[k] for k in lines], field, _logsum)
    starts = np.cumsum([0, *(len(scores[k]) for k in lines)])
    # Words whose sums are asked for: before a span's first word, and after its last; of each line the last.
    before = np.array([starts[at_line[k]] + a for k, a, _ in spans], dtype=np.int64)
    stop = np.array([starts[at_line[k]] + b for k, _, b in spans], dtype=np.int64)
    ended = stop == starts[1:][[at_line[k] for k, _, _ in spans]]
    ask_in, ask_out = np.unique(before), np.unique(stop[~ended])
    n = len(LABELS)
    entered, left, total = np.empty((len(ask_in), n)), np.empty((len(ask_out), n)), np.empty(len(lines))
    offset = np.array([starts[k] + a for k, a, _ in cut.spans], dtype=np.int64)
    for group, live, table in cut.groups(np.arange(len(cut.spans))):
        ways, rest = np.empty_like(table), np.empty_like(table)  # into a word's label; from it on, itself included
        ways[0] = cut.enter[group]
        for t in range(1, len(table)):
            ways[t, : live[t]] = _logsum((ways[t - 1, : live[t]] + table[t - 1, : live[t]])[:, :, None] + field.steps, 1)
        rest[-1] = table[-1] + cut.end[group]
        for t in range(len(table) - 2, -1, -1):
            more = live[t + 1]
            rest[t, :more] = _logsum(field.steps + rest[t + 1, :more, None, :], 2) + table[t, :more]
            rest[t, more:] = table[t, more:] + cut.end[group[more:]]
        for j, s in enumerate(group.tolist()):
            k, a, b = cut.spans[s]
            for asked, out, value in ((ask_in, entered, ways), (ask_out, left, rest)):
                low, high = np.searchsorted(asked, [offset[s], offset[s] + b - a])
                out[low:high] = value[asked[low:high] - offset[s], j]
            if not a:
                total[k] = _logsum(ways[0, j] + rest[0, j], 0)
    out = []
    for (k, a, b), i, done in zip(spans, before, ended):
        path, given = labels[k][a:b], scores[k][a:b]
        own = entered[np.searchsorted(ask_in, i), path[0]] + given[np.arange(b - a), path].sum() + field.steps[path[:-1], path[1:]].sum()
        if not done:
            ends = field.steps[path[-1]] + left[np.searchsorted(ask_out, i + b - a)]
            ends[path[0] + 1] = _NEVER  # a span that goes on is another one
            own += _logsum(ends, 0)
        out.append(float(np.exp(own - total[at_line[k]])))
    return out


def field_spans(texts: list[str], field: Field, least: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the best labels of each text, where the field gives the span a probability of ``least`` or more."""
    owners, words, scores = [], [], []
    for k, text in enumerate(texts):
        for line in lines_of(text):
            if line:
                owners.append(k)
                words.append(line)
                scores.append(field.scores([shape(text[a:b]) for a, b in line]))
    labels = viterbi(scores, field)
    able: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, int]] = []
    for j, (k, line, best) in enumerate(zip(owners, words, labels)):
        begins = best % 2 == 1
        goes_on = (best[:-1] > 0) & (best[1:] == best[:-1] + begins[:-1])
        stops = np.flatnonzero(~np.append(goes_on, False))  # words that their span ends with, or that are in none
        for first in np.flatnonzero(begins).tolist():
            end = int(stops[np.searchsorted(stops, first)]) + 1
            a, b = line[first][0], line[end - 1][1]
            while a < b and texts[k][a] in _EDGE:
                a += 1
            while b > a and texts[k][b - 1] in _EDGE:
                b -= 1
            if a < b and _holds(int(best[first] - 1) // 2, texts[k][a:b]):
                able.append((j, first, end))
                found.append((int(best[first] - 1) // 2, a, b))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (j, _, _), span, probability in zip(able, found, span_probabilities(scores, labels, able, field) if able else []):
        if probability >= least:
            out[owners[j]].append(span)
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: the pattern spans, and those with the field's spans that touch none of them, by kind and start."""
    base = [pattern_spans(t) for t in texts]
    more = field_spans(texts, field)
    out = []
    for b, m in zip(base, more):
        by_start = sorted((x[1], x[2]) for x in b)
        starts, far = [x[0] for x in by_start], list(accumulate((x[1] for x in by_start), max))
        extra = []
        for span in m:
            k = bisect_left(starts, span[2])  # pattern spans that begin before this one ends
            if not k or far[k - 1] <= span[1]:
                extra.append(span)
        out.append((b, sorted({*b, *extra})))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, table: tuple[str, ...] = LABELLED) -> DataFrame:
    """Rows (doc_id, base, spans): joined ``kind:start:end`` of the pattern spans and of all spans, in code points.

    Null texts count as empty and have none; null ids, repeated rows and extra columns pass row by row; an empty table
    gives no rows.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(table))

    def fn(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids, texts = columns
        got = all_spans(texts.to_pylist(), field.value)
        yield pa.RecordBatch.from_arrays([ids, pa.array([_joined(b) for b, _ in got], pa.string()), pa.array([_joined(s) for _, s in got], pa.string())], names=["doc_id", "base", "spans"])

    return scan_texts(docs, fn, "doc_id long, base string, spans string")


def redact(docs: DataFrame, table: tuple[str, ...] = LABELLED) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets (overlapping spans by the first one's), n_chars renewed.

    The columns of ``docs`` stay as they are otherwise; a null text stays null.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(table))
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at, 4 << 20):
                yield pa.RecordBatch.from_arrays(masked(batch), schema=batch.schema)

    def masked(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text_at).to_pylist()
        for k, (_, spans) in enumerate(all_spans([t or "" for t in texts], field.value)):
            if not spans:
                continue
            parts, at = [], 0
            for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [texts[k][at:a], f"<{KINDS[kind]}>"]
                at = max(at, b)
            texts[k] = "".join([*parts, texts[k][at:]])
        columns = list(batch.columns)
        columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        if chars_at is not None:
            columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_at).type)
        return columns

    return docs.mapInArrow(run, docs.schema)
