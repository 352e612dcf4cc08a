"""The pipeline against its stages' decisions, worked out by plain loops."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_fingerprint, crc, lower, token_ids, words

from typeahead.llm import binpack, common, crf_langid, simhash_vp, tokens


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in crf_langid.drop_unidentified(docs).collect()}
    assert all(i in kept for i, t in rows.items() if t and len(words(t)) > 20)

    last = {}
    for i in sorted(kept):
        last[lower(rows[i])] = i
    kept = set(last.values())

    prints = {i: brute_fingerprint(rows[i]) for i in kept}
    root = brute_components(set(prints.values()))
    first = {}
    for i in sorted(kept):
        first.setdefault(root[prints[i]], i)
    kept = set(first.values())

    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        ws = words(r.text)
        n = min(10, len(ws))
        grams |= {tuple(ws[s:s + n]) for s in range(len(ws) - n + 1)} if ws else set()
    sizes = {len(g) for g in grams}

    def clean(ws):
        return not any(tuple(ws[p:p + n]) in grams for n in sizes for p in range(len(ws) - n + 1))
    kept = {i for i in kept if clean(words(rows[i]))}

    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == kept
    for r in got:
        ids = token_ids(rows[r.doc_id], 0)
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start:r.start + r.length])
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 1024 for parts in used.values())


def test_stage_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("id", F.lit(1))
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, sf).columns == docs.columns, name


def test_workers_give_memory_back(monkeypatch):
    """Spark reuses Python workers: caches serve the next task of their kind, and go before other work."""
    freed = []
    monkeypatch.setattr(common, "free_unused", lambda: freed.append(1))
    model = crf_langid.train([("the cat sat on the mat", "en"), ("der hund lief durch den wald", "de")] * 9)

    def rows(*columns):
        return iter([pa.RecordBatch.from_arrays(list(map(pa.array, columns)), list("abc")[:len(columns)])])

    def languages():
        return list(crf_langid.accept_batches(rows([1], ["the cat lief"]), model=model, text_at=1, min_score=0.0))

    assert languages()[0].num_rows == 1
    kept = crf_langid._emissions[model["id"]]
    languages()
    assert crf_langid._emissions[model["id"]] is kept and len(freed) == 2
    list(simhash_vp.fingerprint_batches(rows([1], ["the cat"], [7]), shingle=4))
    assert not crf_langid._emissions
    list(binpack.cut_pieces(rows([1], ["the cat"]), binpack.tokenizer_file(), 0, 1024))
    assert tokens._encoders
    languages()
    assert not tokens._encoders and len(freed) == 5
