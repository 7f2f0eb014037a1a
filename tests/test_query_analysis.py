import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.operators import providers, query_analysis as qa
from lectern.operators import sync


def test_filters():
    f = qa.filters("open issues about Deployment and kind: CronJob in batch/v1beta1 for Kubernetes v1.30")
    assert f["kinds"] == ["CronJob", "Deployment"] and f["api_groups"] == ["batch"] and f["api_versions"] == ["v1beta1"] and f["versions"] == ["1.30"]
    assert f["issue_states"] == ["open"] and f["document_types"] == ["github_issue"]
    f = qa.filters("release notes v1.29.3, 版本 1.28 官方文档")
    assert f["release_versions"] == ["v1.29.3"] and f["versions"] == ["1.28"] and f["document_types"] == ["official_documentation", "release_note"]
    assert not any(qa.filters("nothing to see; foo/v1 and v1").values())


def test_normal_form_and_terms():
    assert qa.normalised(" a\u0000ｂ \n c ") == "ab c"
    with pytest.raises(ValueError):
        qa.normalised(" ")
    assert qa.protected_terms("run `kubectl get po` on apps/v1 with maxSurge 1.30 kubectl", ["Pod"]) == ["kubectl get po", "kubectl", "apps/v1", "maxSurge", "1.30", "Pod"]


def test_rewrites(spark):
    from pyspark.sql import functions as F

    from lectern.operators import answering

    rows = spark.createDataFrame([("and how does it scale?", 2), ("and how does it scale?", 0), ("scale a set", 2)], "q string, n int")
    assert [r.x for r in rows.select(qa.rewrite_reason(F.col("q"), F.col("n")).alias("x")).collect()] == ["rewrite", "no_history", "independent_query"]
    kept = rows.limit(1).select(answering.rewrite_kept(F.lit("scale it"), F.lit("scale v1.99"), F.lit("about v1.30")).alias("a"), answering.rewrite_kept(F.lit("scale it"), F.lit("scale v1.30"), F.lit("about v1.30")).alias("b")).first()
    assert (kept.a, kept.b) == ("scale it", "scale v1.30")


def test_providers(spark):
    v = providers.hash_vector("x", 70)
    assert len(v) == 70 and math.isclose(float(v @ v), 1) and (v == providers.hash_vector("x", 70)).all() and not np.allclose(v[:32], v[32:64])
    rows = providers.embed(spark.createDataFrame([(1, "x"), (2, None)], "id long, text string"), 8).collect()
    assert [len(r.embedding) for r in rows] == [8, 8]
    with pytest.raises(Exception, match="wrong count or dimension"):
        providers.embed(spark.createDataFrame([(1, "x")], "id long, text string"), 8, make=lambda texts: [np.zeros(3)]).collect()
    assert providers.redacted("failed: token=abc https://u:p@h/ s3cret", ["s3cret"]) == "failed: token=[REDACTED] https://[REDACTED]@h/ [REDACTED]"


def test_write_back_is_guarded(spark):
    chunks = spark.createDataFrame([(1, "a", False, None), (2, "b", False, None), (3, "c", True, None)], "id long, hash string, deleted boolean, embedding array<double>")
    made = spark.createDataFrame([(1, "a", [1.0]), (2, "old", [2.0]), (3, "c", [3.0])], "id long, hash string, embedding array<double>")
    assert {r.id: r.embedding for r in sync.write_back(chunks, made).collect()} == {1: [1.0], 2: None, 3: None}


def test_marking_duplicates_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "active", None), (2, "active", None)], "external_id long, status string, deleted_at timestamp_ntz")
    got = {r.external_id: r.status for r in sync.mark_duplicates(rows, spark.createDataFrame([(2,)], "external_id long"), "2024-01-01").collect()}
    assert got == {1: "active", 2: "duplicate"}


@pytest.mark.parametrize("batch_rows", [32, 100, 300])
def test_embedding_holds_few_rows_of_a_batch(batch_rows):
    class Rows:
        columns = ["id", "text"]
        schema = StructType([StructField("id", LongType()), StructField("text", StringType())])

        def mapInArrow(self, run, schema):
            return run

    made = list(providers.embed(Rows(), 8, batch_rows=batch_rows)(iter([pa.record_batch({"id": range(1000), "text": [f"t{i}" for i in range(1000)]})])))
    assert max(b.num_rows for b in made) <= max(256, batch_rows)
    whole = pa.Table.from_batches(made)
    assert whole["id"].to_pylist() == list(range(1000))
    assert whole["embedding"].to_pylist()[777] == pa.array(providers.hash_vector("t777", 8), pa.float32()).to_pylist()
