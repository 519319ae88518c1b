"""Operator 11 against all pairs and against its SQL."""

import random
import re

import duckdb
import numpy as np
import pytest

from barloom.llm import jaccard, registry

SCHEMA = "doc_id long, text string, node long, key string, n long, component_id string, root string"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def plain(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and 100 * s >= 85 * (len(sets[a]) + len(sets[b]) - s):
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def made(rng, n):
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", " \t\n", "one", "one two", "One TWO", "a b c d", "a b c d e", "ÉA b c d", "éa b c d", "x\x0by z\x1cq r s t"]
    seeds = [[rng.choice(words) for _ in range(m)] for m in (5, 6, 7, 8, 9, 10, 12, 15, 16, 17, 31, 33, 60, 64, 70, 150, 260, 300)]
    while len(texts) < n:
        text = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2, 3, 8])):
            k = rng.randrange(len(text))
            text[k : k + rng.choice([0, 1, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            text = text or ["x"]
        if rng.random() < 0.3 and len(text) > 20:
            text = text[: -rng.randint(1, len(text) // 5)]
        if rng.random() < 0.3:
            seeds.append(text)
        texts.append(rng.choice([" ", "  ", "\n"]).join(text))
    return texts


@pytest.mark.parametrize("rare, common, blocks", [(7, 14, 2000), (0, 1, 2000), (0, 0, 3), (0, 9, 5)])
def test_equals_all_pairs(spark, rare, common, blocks):
    texts = made(random.Random(rare + common), 260)
    ids = [None, None, *range(1, len(texts) - 1)]
    ids[40] = ids[41] = 30
    ids[50] = None
    got = jaccard.join(table(spark, texts, ids).repartition(6), rare=rare, common=common, bits=16, block_rows=blocks)
    assert ours(got) == plain(list(zip(ids, texts)))


@pytest.mark.parametrize("rare, common", [(255, 255), (0, 255), (0, 0), (2, 5)])
def test_linked_sets_share_a_key(rare, common):
    rng = np.random.default_rng(rare + common)
    levels = rng.integers(1 if rare == 0 else 0, 9, 1 << 10).astype(np.uint8)
    for n in [*range(6, 40), 63, 64, 65, 100, 127, 128, 300, 1000]:
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for _ in range(6):
            # One link apart, to the last shingle: c of n stay and m come in, with 100 c >= 85 (n + m).
            m = int(rng.integers(0, n))
            c = next((k for k in range(n + 1) if 100 * k >= 85 * (n + m)), None)
            if c is None:
                m, c = 0, -(-85 * n // 100)
            other = np.concatenate([rng.permutation(base)[:c], rng.integers(0, 2**64, m, dtype=np.uint64)])
            value = np.concatenate([np.sort(base), np.sort(other)])
            doc = np.repeat([0, 1], [n, c + m])
            key, owner = jaccard.combinations(value, doc, levels, rare, common, 85)
            assert set(key[owner == 0]) & set(key[owner == 1]), (n, m, c)


def test_equals_sql_on_the_smallest_tables(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(registry.oracle_sql()["op11_combination_join"]).fetchall()
    got = ours(registry.queries()["op11_combination_join"](spark, sf))
    assert got == sorted(want, key=str) and any(r[0] != r[2] for r in got)


def test_bitmaps_bound_what_is_shared():
    rng = np.random.default_rng(4)
    for n in (1, 5, 8, 100, 1000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for kept in {0, n // 2, n - 1, n}:
            other = np.concatenate([base[:kept], rng.integers(0, 2**64, n // 3 + 1, dtype=np.uint64)])
            a, b = jaccard.bitmaps(np.concatenate([base, other]), np.repeat([0, 1], [n, len(other)]), 2)
            size = min(len(a), len(b))
            most = jaccard.most_shared(jaccard.folded(a, size), n, jaccard.folded(b, size)[None], np.array([len(other)]))[0]
            assert kept <= most <= min(n, len(other))
            assert kept or n < 100 or most < 0.4 * n


def test_a_chain_of_links(spark):
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words[k * 4 : k * 4 + 100]) for k in range(120)]
    got = jaccard.join(table(spark, texts).repartition(9), block_rows=7, rare=1, common=2)
    assert ours(got) == plain(list(enumerate(texts)))


def test_many_near_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for k in range(1500):
        text = list(base)
        text[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(text))
    assert {r[2] for r in ours(jaccard.join(table(spark, texts)))} == {0}


def test_empty_tables(spark):
    assert jaccard.join(table(spark, ["x"]).where("false")).count() == 0
    assert ours(jaccard.join(table(spark, [None, "  "]))) == [(0, 0, 0), (1, 0, 1)]
    with pytest.raises(ValueError):
        jaccard.join(table(spark, ["x"]), percent=50)
