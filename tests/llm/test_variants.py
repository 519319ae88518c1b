"""Operator 13 against a brute-force version."""

import collections
import random
import re
import zlib

import pytest

from barloom.llm import registry, variants

SCHEMA = "doc_id long, text string, id string, word string, n string, root string, key string"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", "y", "z", "r", "k") for i, t in zip(ids, texts)], SCHEMA)


def counted(rows):
    out = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = counted(rows)
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    form, near = {}, {}
    for w in n:
        others = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if is_near(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        top = w
        while form[top] is not None:
            top = form[top]
        out.append((w, form[w], top, n[w], near[w], n.get(form[w])))
    return sorted(out)


def ours(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def made(rng, n):
    seeds = ["letters", "aaaaaa", "ababab", "façade", "straße", "ÀÉÎõü", "mississippi", "x" * 300]
    pool = []
    for w in seeds:
        pool.append(w)
        for _ in range(25):
            v = rng.choice(pool)
            k = rng.randrange(len(v))
            pool.append(rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("abxÿ÷") + v[k:], v[:k] + rng.choice("absé") + v[k + 1 :], v.upper() if v.isascii() else v]))
    texts = [None, "", " 12 ", "é漢字é", "Letters-letters_letters letters9letters"]
    return texts + [rng.choice([" ", ", ", "1"]).join(rng.choices(pool, weights=[1 / (k % 26 + 1) for k in range(len(pool))], k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("radix_rows, batch", [(1_000_000, 256 << 10), (300, 500)])
def test_equals_brute_force(spark, radix_rows, batch):
    texts = made(random.Random(4), 400)
    ids = [None, *range(3, len(texts) + 2)]
    got = variants.group(table(spark, texts, ids).repartition(5), radix_rows=radix_rows, batch_bytes=batch)
    want = plain(list(zip(ids, texts)))
    assert ours(got) == want and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)


def test_equals_brute_force_on_the_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert ours(registry.queries()["op13_spelling_variants"](spark, sf)) == plain(rows)


def test_small_parts_give_the_same_counts(spark):
    texts = made(random.Random(5), 60)
    rows = list(zip(range(len(texts)), texts))
    got = variants.word_counts(table(spark, texts), most_bytes=50, most_words=20).where("n >= 3")
    assert {r.word: r.n for r in got.collect()} == counted(rows)


def test_chains_end_at_the_root(spark):
    words = ["abcde" + "f" * k for k in range(12)]
    texts = [" ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)) for _ in range(2)]
    got = {r.word: (r.form, r.root) for r in variants.group(table(spark, texts), spoil=10**9).collect()}
    assert got == {w: (words[k + 1] if k < 11 else None, words[-1]) for k, w in enumerate(words)}


def test_very_long_words(spark):
    w = "ab" * 60_000
    texts = [f"{w} {w[:5000]}x{w[5000:]} {w[:-1]} {w[:99]}z{w[100:]}"] * 3
    got = {len(r.word): r.n_near for r in variants.group(table(spark, texts), spoil=10**9).where("word not like '%z%'").collect()}
    assert got == {120_001: 1, 120_000: 3, 119_999: 1}


def test_empty_tables(spark):
    assert variants.group(table(spark, ["x"]).where("false")).count() == 0
    assert variants.group(table(spark, [None, ""])).count() == 0
