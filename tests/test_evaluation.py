import math

from pyspark.sql import functions as F

from lectern.operators import evaluation, usage


def test_retrieval_metrics(spark):
    retrieved = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "case_id long, chunk_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 13)], "case_id long, chunk_id long")
    r = evaluation.retrieval(retrieved, relevant, spark.createDataFrame([(1,), (2,)], "case_id long"), (1, 3, 5)).orderBy("case_id").collect()
    assert (r[0].recall_1, r[0].recall_3, r[0].recall_5, r[0].coverage_1, r[0].coverage_3, r[0].coverage_5, r[0].reciprocal_rank) == (0, 1, 1, 0, 0.5, 1, 0.5)
    assert r[1].recall_5 == r[1].reciprocal_rank == 0


def test_answer_metrics(spark):
    rows = spark.createDataFrame([("a b c", "a b c d"), ("", ""), ("x", ""), ("use v1.30", "use v1.30"), ("use v1.29", "use v1.30"), ("Ｆｕｌｌ ﬁt", "full FIT"), (None, "x")], "g string, r string")
    got = evaluation.answer_metrics(rows, "g", "r").collect()
    assert math.isclose(got[0].token_f1, 6 / 7, abs_tol=1e-8) and got[0].keyword_coverage == 0.75
    assert (got[1].token_f1, got[1].exact_match, got[2].token_f1) == (1, 1, 0)
    assert (got[3].numeric_consistency, got[4].numeric_consistency) == (1, 0)
    assert (got[5].exact_match, got[5].token_f1, got[6].exact_match) == (1, 1, 0)


def test_confusion(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "expected boolean, predicted boolean")
    r = evaluation.confusion(rows).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)


def test_latencies(spark):
    rows = spark.createDataFrame([(10.0, False), (20.0, False), (30.0, False), (40.0, False), (0.0, True)], "latency_ms double, failed boolean")
    r = usage.latency_summary(rows, 2).first()
    assert (r.mean, r.p50, r.throughput, r.error_rate) == (25, 25, 2.5, 0.2)
    assert usage.latency_summary(rows.limit(0), 2).first().p50 == 0


def test_costs_are_all_or_null(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, cost int")
    assert {r.k: r.c for r in rows.groupBy("k").agg(usage.all_or_null().alias("c")).collect()} == {"a": None, "b": 2}
    assert rows.limit(0).agg(usage.all_or_null().alias("c")).first().c is None


def test_calibration(spark):
    rows = spark.createDataFrame([(0.9, True), (0.7, True), (0.3, False), (None, False)], "score double, answerable boolean")
    best = evaluation.calibrated(rows).first()
    assert 0.3 < best.threshold <= 0.7 and best.f1 == 1


def test_citations(spark):
    cited = spark.createDataFrame([(1, True, 0.9), (1, False, 0.2)], "case_id long, valid boolean, score double")
    claims = spark.createDataFrame([(1, True, True), (1, True, False), (1, False, False)], "case_id long, required boolean, supported boolean")
    r = evaluation.citations(cited, claims, spark.createDataFrame([(1,), (2,)], "case_id long")).orderBy("case_id").collect()
    assert (r[0].precision, r[0].recall, r[0].correctness) == (0.5, 0.5, 0.55)
    assert (r[1].precision, r[1].recall) == (0, 1)
    assert spark.range(1).select(evaluation.expected_citation_recall(F.array(), F.array()).alias("x")).first().x == 1
