"""The pipeline: each stage against brute force or its operator, and its defined cases."""

from collections import Counter, defaultdict

from scanlake.llm import mixing, quality

from . import brute
from .test_pipeline_ops import SF, empty, odd_documents


def one_of_each(rows):
    """rows: id, text. The ids that stay: the smallest of each group of similar texts."""
    groups = defaultdict(list)
    for (i, _), g in zip(rows, brute.similar_groups([t for _, t in rows]), strict=True):
        groups[g].append(i)
    return sorted(min(g, key=lambda i: (i is None, i)) for g in groups.values())


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.query(spark, SF).collect() if r.kept}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.near_dedup(spark, first, SF)
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == one_of_each([(r.doc_id, r.text) for r in first.collect()])
    third = corpus_pipeline.mix(spark, second, SF)
    assert Counter(r.doc_id for r in third.collect()) == Counter({r.doc_id: r.times for r in mixing.mix(second).collect() if r.taken})
    words_in = sum(r.length for r in corpus_pipeline.pack(spark, third, SF).collect())
    assert words_in == sum(r.length for r in corpus_pipeline.run(spark, SF).collect()) > 0


def through(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_pipeline_defined_cases(spark):
    docs = odd_documents(spark)
    left, pieces = through(spark, docs)
    assert left.columns == docs.columns
    # 3, 4, 5, 6 and the wordless fail the base rules; 1, 2, 2, 7 and the row without an id are similar
    assert {r.doc_id for r in left.collect()} <= {1, None} and {r.doc_id for r in pieces} == {r.doc_id for r in left.collect()}
    none, no_pieces = through(spark, empty(spark))
    assert none.count() == 0 and no_pieces == [] and none.columns == docs.columns
    nulls = spark.createDataFrame([(None,) * len(docs.columns)] * 3, docs.schema)
    none, no_pieces = through(spark, nulls)
    assert none.count() == 0 and no_pieces == []
