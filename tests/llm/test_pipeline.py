import corpus_pipeline
from lacuna.llm.ngram_join import jaccard_components


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from lacuna.llm.common import materialise

        after = materialise(stage(spark, before, "/root/testdata/sf0.001"), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        n, m = before.count(), after.count()
        if name == "language_id":
            assert m >= 0.98 * n
        if name == "ngram_jaccard":
            assert jaccard_components(before, width=5, percent=80).select("component_id").distinct().count() == m
        if name == "mixing":
            assert m >= n and after.select("doc_id").distinct().count() == n
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert last.count() == before.count() and last.where("n_tokens > 0 and size(ids) = n_tokens").count() == last.count()


def words(n, base=0):
    return " ".join(f"w{base + i}" for i in range(n))


def tricky(spark):
    rows = [(None, words(40, 100), "a"), (None, words(40, 200), "a"), (None, words(40, 300), "b"), (1, words(40, 400), "b"), (1, words(40, 500), "b"), (2, words(40, 600), None)]
    return rows, lambda more=(): spark.createDataFrame([*rows, *more], "doc_id long, text string, source string").repartition(3)


def test_null_and_repeated_ids_stay(spark):
    rows, make = tricky(spark)
    # a null id whose text has an id goes, of two null ids with one text one stays, and so does one of equal rows
    more = [(None, rows[5][1], "z"), (None, rows[0][1], "a"), (1, rows[3][1], "b"), (9, rows[4][1] + " end", "b")]
    got = corpus_pipeline.drop_near_duplicates(spark, make(more), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((d or 0, t) for d, t, _ in rows)


def test_mixing_keeps_null_and_repeated_ids(spark):
    from collections import Counter

    rows, make = tricky(spark)
    got = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, make(), "").collect())
    assert set(got) == set(rows)
    from lacuna.llm import mixing

    assert sum(got.values()) == mixing.mix(make()).count()


def test_mixing_writes_the_interleaving(spark):
    from pathlib import Path

    import pyarrow.parquet as pq
    from lacuna.llm import mixing
    from lacuna.llm.common import materialise

    docs = spark.createDataFrame([(i, f"t {i}", "abc"[min(2, i % 5)]) for i in range(300)], "doc_id long, text string, source string").repartition(4)
    want = [r.source for r in mixing.mix(docs).orderBy("slot").collect()]
    path = materialise(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")._scratch
    files = sorted(Path(path.removeprefix("file:")).glob("part-*.parquet"))
    assert [x for f in files for x in pq.read_table(f)["source"].to_pylist()] == want
