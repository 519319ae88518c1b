"""Operator 12 against a brute-force version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import registry, resample
from barloom.llm.crc import Joiner

SCHEMA = "doc_id long, text string, weight string, rank long, text_key string, n string"


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "x", 5, "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def ours(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts_of(rng, n):
    words = [f"{a}{b}" for a in "abÅé漢" for b in range(40)]
    odd = [None, "", "  ", "One two", "one", "-", "a" * 500 + " b", "x" * 70 + "é y\x00z UPPER lower", "same words here " * 9, "same words here " * 9]
    return odd + [rng.choice(" ,.").join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("most", [4 << 20, 64])
def test_equals_brute_force(spark, most):
    rng = random.Random(1)
    texts = texts_of(rng, 300)
    ids = [None, *range(5, len(texts) + 4)]
    target = texts[40:60] + [None, ""]
    got = resample.weigh(table(spark, texts, ids).repartition(5), table(spark, target), most_bytes=most)
    assert ours(got) == plain(list(zip(ids, texts)), target)


def test_equals_brute_force_on_the_smallest_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ours(registry.queries()["op12_importance_resampling"](spark, sf)) == plain(rows, target)


def test_joined_crcs():
    rng, join = random.Random(2), Joiner()
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(n)) for n in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 100_000]]
    got = join.join(*(np.array(x) for x in ([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs])), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_repeated_rows_and_ties(spark):
    text = " ".join(f"w{k}" for k in range(30))
    ids = [7] * 50 + list(range(100, 150))
    got = resample.weigh(table(spark, [text] * 100, ids).repartition(7), table(spark, ["w1 w2"]), percent=80).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 81))
    best = sorted(got, key=lambda r: (-r.score, r.doc_id))
    assert [r.doc_id for r in best][:80] == [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]


def test_drawn_rows_are_whole(spark):
    docs = table(spark, texts_of(random.Random(3), 200))
    drawn = resample.draw(docs, table(spark, ["a1 a2 a3"]), percent=10)
    assert drawn.columns == [*docs.columns, "rank_in_sample"]
    n = docs.where(F.size(F.expr("filter(split(lower(text), '[ ,.]'), x -> x != '')")) >= 20).count()
    assert sorted(r.rank_in_sample for r in drawn.collect()) == list(range(1, n // 10 + 1))


def test_empty_tables(spark):
    docs = table(spark, ["a b c"])
    assert resample.weigh(docs.where("false"), docs).count() == 0
    assert resample.weigh(docs, docs.where("false")).count() == 1
    assert resample.draw(docs.where("false"), docs).count() == 0
