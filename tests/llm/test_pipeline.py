"""The pipeline, stage by stage, on the smallest tables; and the registered queries."""

import hashlib
import re

import corpus_pipeline
from barloom.llm import bagminhash, bm25, crf, pieces, quality, registry


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "pieces"]
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        got = after.collect()
        if name != "pieces":
            assert after.columns == docs.columns
        ids = {r.doc_id for r in before.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality.classify(before, labels).where("keep").collect()}
        elif name == "near_duplicates":
            want = {r.class_id for r in bagminhash.near_duplicates(before).collect()}
        elif name == "decontamination":
            want = ids - {r.doc_id for r in bm25.leaks(before, items).collect()}
        else:
            want = ids
        assert {r.doc_id for r in got} == want and len(got) == len(want)
        if name == "personal_data":
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text) for r in got)
            texts = {r.doc_id: r.text for r in got}
            assert any(texts[k] != rows[k] for k in texts)
        before = spark.createDataFrame(got, after.schema)
    vocabulary = pieces.Pieces()
    assert all(r.round_trip and vocabulary.decode(r.ids) == texts[r.doc_id] for r in got)


def test_stages_with_nulls_empty_texts_and_clashing_columns(spark, sf):
    long = " ".join(f"word{k % 977} goes{k % 31} on" for k in range(20_000))
    texts = [None, "", "  ", "a plain line of text that is like others of its kind", "a plain line of text that is like others of its kind", long, "mail a.b@c.de now", "twice over", "twice over"]
    ids = [1, 2, None, 4, 5, 6, 7, 8, 8]
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "web", None, "x", 7, "y", 0.5) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string, key long, host string, prior double")
    for start in (docs, docs.where("false")):
        before = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, sf)
            if name != "pieces":
                assert after.columns == docs.columns
            got = after.collect()
            before = spark.createDataFrame(got, after.schema)
        assert bool(got) == (start is docs)
        assert all(r.round_trip for r in got)


def test_pii_digest(spark, sf):
    rows = registry.queries()["op5_crf_pii"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def holds(kind, part):
        digits = re.sub("[^0-9]", "", part)
        if kind == 1:
            return all(int(x) <= 255 for x in part.split("."))
        if kind == 2:
            doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == 0 or 8 <= len(digits) <= 15

    for r in rows:
        spans = [(k, *m.span()) for k, p in enumerate(plain) for m in p.finditer(texts[r.doc_id] or "") if holds(k, m[0])]
        joined = ",".join(f"{crf.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]


def test_all_operators_are_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
