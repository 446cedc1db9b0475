import corpus_pipeline
from folioscope.llm import decontaminate, langid, suffix_dedup
from folioscope.llm.queries import oracle_sql, queries

from .test_decontaminate import brute as brute_windows
from .test_similar import brute as brute_similar
from .test_suffix_dedup import brute as brute_repeats


def test_stages_one_by_one(spark, sf, documents, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece_encoding"]
    columns = documents.columns
    docs = corpus_pipeline.language_id(spark, documents, sf).cache()
    assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == {i for i, t in texts if any(c.isalpha() for c in t or "")}

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    docs = corpus_pipeline.near_dedup(spark, docs, sf).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(brute_similar(rows))

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    docs = corpus_pipeline.suffix_array_dedup(spark, docs, sf).cache()
    assert docs.columns == columns and docs.count() == len(rows)
    left = {r.doc_id: r.text for r in docs.collect()}
    for i, n, gone, spans, _ in brute_repeats(rows):
        assert n - gone <= len(left[i].encode()) <= n - gone + 6 * spans

    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = corpus_pipeline.decontamination(spark, docs, sf).cache()
    clean = {r.doc_id: r.text for r in docs.collect()}
    for i, n, hit, _ in brute_windows(rows, items):
        assert (clean[i] == dict(rows)[i]) == (hit == 0)
        assert len(brute_windows([(i, clean[i])], [])) == 1 and brute_windows([(i, clean[i])], [])[0][1] == n - hit

    out = corpus_pipeline.encoding(spark, docs, sf).collect()
    assert len(out) == len(clean) and all(r.round_trip for r in out)


def test_odd_rows_pass_all_stages(spark, sf, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns[0] == "doc_id"
        docs.count()


def test_registry():
    assert {q.split("_")[0] for q in queries()} == {"pipeline", *(f"op{n}" for n in range(1, 11))}
    assert set(oracle_sql()) <= set(queries())
    assert decontaminate and langid and suffix_dedup
