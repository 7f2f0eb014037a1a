import math

from lectern.operators import fusion


def channel(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, chunk_id long, rank int, score double")


def scores(df):
    return {r.chunk_id: r.fused_score for r in df.collect()}, [r.chunk_id for r in df.orderBy("fused_rank").collect()]


def test_reciprocal_ranks_add_up(spark):
    got, order = scores(fusion.rrf(channel(spark, [(1, 1, None), (2, 2, None)]), channel(spark, [(2, 1, None), (3, 2, None)])))
    assert order == [2, 1, 3] and math.isclose(got[2], 1 / 62 + 1 / 61, abs_tol=1e-9)


def test_a_chunk_counts_once_by_its_best_rank(spark):
    df = fusion.rrf(channel(spark, [(1, 5, None), (1, 2, None)]), channel(spark, []))
    assert [r.keyword_rank for r in df.collect()] == [2]


def test_weights_and_ties(spark):
    got, order = scores(fusion.weighted(channel(spark, [(1, 1, 10.0), (2, 2, 5.0)]), channel(spark, [(2, 1, 0.7), (3, 2, 0.7)]), 3, 1))
    assert got == {1: 0.75, 2: 0.25, 3: 0.25} and order == [1, 2, 3]


def test_a_channel_without_scores_counts_by_rank(spark):
    got, _ = scores(fusion.weighted(channel(spark, [(1, 1, None), (2, 2, None)]), channel(spark, [])))
    assert got == {1: 0.5, 2: 0.25}


def test_normalised_scores(spark):
    rows = fusion.normalised(channel(spark, [(1, 1, -2.0), (2, 2, 0.0), (3, 3, 2.0), (4, 4, None), (5, 5, float("nan"))]))
    assert [r.unit for r in rows.orderBy("chunk_id").collect()] == [0, 0.5, 1, 0, 0]
    tied = fusion.normalised(channel(spark, [(1, 1, 7.0), (2, 2, 7.0), (3, 3, None)]))
    assert [r.unit for r in tied.orderBy("chunk_id").collect()] == [1, 1, 0]


def test_a_failed_reranker_keeps_the_fused_order(spark):
    from pyspark.sql import functions as F

    fused = fusion.rrf(channel(spark, [(1, 1, None), (2, 2, None)]), channel(spark, []))
    good = fusion.reranked(fused, F.when(F.col("chunk_id") == 2, 0.9).otherwise(0.1))
    assert [r.chunk_id for r in good.orderBy("position").collect()] == [2, 1]
    bad = fusion.reranked(fused, F.when(F.col("chunk_id") == 2, 0.9))
    assert [(r.chunk_id, r.rerank_score) for r in bad.orderBy("position").collect()] == [(1, None), (2, None)]


def test_table_functions_in_sql(spark):
    from lectern.functions import tables

    tables.register(spark)
    keyword = [(1, "a", 1), (1, "b", 2), (1, "a", 5), (2, "c", 1), (3, "d", None)]
    vector = [(1, "b", 1), (1, "d", 2), (2, "c", 3), (2, "a", 1)]
    rows = [(q, n, c, r) for n, some in (("keyword", keyword), ("vector", vector)) for q, c, r in some]
    spark.createDataFrame(rows, "query_id int, channel string, chunk_id string, rank int").createOrReplaceTempView("channels")
    got = spark.sql("SELECT * FROM ranked_fusion(TABLE(channels)) ORDER BY query_id, fused_rank").collect()
    assert [(r.query_id, r.chunk_id, r.fused_rank) for r in got] == [(1, "b", 1), (1, "a", 2), (1, "d", 3), (2, "c", 1), (2, "a", 2)]
    named = lambda some: spark.createDataFrame([(q, c, r, None) for q, c, r in some if r], "query_id int, chunk_id string, rank int, score double")
    want = {(r.query_id, r.chunk_id): r.fused_score for r in fusion.rrf(named(keyword), named(vector)).collect()}
    assert {(r.query_id, r.chunk_id): r.fused_score for r in got} == want
    assert spark.sql("SELECT fused_score FROM ranked_fusion(TABLE(channels), 0) WHERE query_id = 2 AND chunk_id = 'a'").first().fused_score == 1.0
    spark.createDataFrame([(1, 3, "x"), (1, 9, "y"), (2, 4, "z")], "id int, at int, text string").createOrReplaceTempView("versions")
    assert sorted(map(tuple, spark.sql("SELECT id, text FROM newest_rows(TABLE(versions))").collect())) == [(1, "y"), (2, "z")]
    import pytest

    with pytest.raises(Exception, match="no column rank"):
        spark.sql("SELECT * FROM ranked_fusion(TABLE(SELECT 1 AS query_id, 2 AS chunk_id, 'x' AS channel))").collect()
