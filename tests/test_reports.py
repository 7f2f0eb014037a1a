import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answering, catalogue, documents, evaluation, fusion, query_analysis, ranges, reports, search, sync, usage
from lectern.sources import readers, sinks


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_filters_and_metadata(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for pair in kv.items() for x in pair])
    row = one(spark, search.merged_metadata(m(a="1", b="2"), m(b="3")), search.contains_all(F.array(F.lit("x"), F.lit("y")), ["y"]), search.contains_all(F.array(F.lit("x")), ["y"]))
    assert row.c0 == {"a": "1", "b": "3"} and row.c1 and not row.c2
    assert search.validated_filters({"a": [1, "b"], "c": None}) == {"a": [1, "b"], "c": None}
    for bad in ({"a": {"b": 1}}, {str(i): 1 for i in range(21)}, {"a": float("nan")}, {"a": list(range(51))}, {"a": "x" * 513}):
        with pytest.raises(ValueError):
            search.validated_filters(bad)


def test_answer_checks(spark):
    rows = spark.createDataFrame([(1, 1, 0, 1.0, True), (2, 0, 1, 1.0, True), (3, 0, 0, 0.5, True), (4, 0, 0, 0.9, True)], "id int, invalid_markers int, unsupported_markers int, coverage double, answerable boolean")
    got = {r.id: (r.reason, r.answerable) for r in answering.after_answer(rows).collect()}
    assert got == {1: ("invalid_citation", False), 2: ("unsupported_citation", False), 3: ("citation_coverage_low", False), 4: (None, True)}
    none = F.lit(None).cast("double")
    row = one(spark, answering.blended(F.lit(1.0), none), answering.blended(F.lit(1.0), F.lit(0.0)), answering.rendered(F.lit(2), F.lit("a\nb"), F.lit("x\ny [SOURCE 1]")), evaluation.answer_correct(F.lit(4), F.lit(5)), evaluation.answer_correct(F.lit(4), none))
    assert (row.c0, row.c1) == (1.0, 0.35) and row.c2 == "[2] a b\n| x\n| y [ESCAPED_BOUNDARY 1]" and row.c3 is True and row.c4 is None
    assert one(spark, T.escaped_field(F.lit(" a \n [/source x]")), T.quoted(F.lit(""))) == ("a [ESCAPED_BOUNDARY x]", "|")


def test_merged_filters_and_loaders(spark):
    a = lambda *xs: F.array(*map(F.lit, xs))
    row = one(spark, query_analysis.merged(a("x"), a("y", "y")), query_analysis.merged(a("x"), F.array().cast("array<string>")))
    assert (row.c0, row.c1) == (["y"], ["x"])
    assert readers.loader("github_issues")["complete_snapshot"] and not readers.loader("github_issues", "2024")["complete_snapshot"]


def test_presented_order(spark):
    rows = spark.createDataFrame([(1, 1, None, 2, 1, None), (1, 2, 1, 1, None, 3), (1, 3, None, None, 2, 1)], "query_id long, chunk_id long, rerank_rank int, fused_rank int, keyword_rank int, vector_rank int")
    assert [r.chunk_id for r in fusion.presented(rows).collect()][0] == 2


def test_reports_replace_old_ones(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c"), (1, None)], "id long, a string")
    for kind in ("json", "csv", "parquet"):
        sinks.write_report(rows, f"{tmp_path}/{kind}", kind)
        sinks.write_report(rows.limit(1), f"{tmp_path}/{kind}", kind)
        assert sinks.read_report(spark, f"{tmp_path}/{kind}").columns == ["a", "id"] and sinks.read_report(spark, f"{tmp_path}/{kind}").count() == 1
    assert not [p for p in tmp_path.iterdir() if p.name not in ("json", "csv", "parquet")]
    sinks.write_lines(rows, f"{tmp_path}/lines")
    assert [json.loads(r.value)["id"] for r in spark.read.text(f"{tmp_path}/lines").collect()] == [1, 2]
    assert "| 2 | b\\|c |" in sinks.markdown_table(rows.select("id", "a")) or "b\\|c" in sinks.markdown_table(rows)


def test_a_killed_write_leaves_the_old_report(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/report", spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    with pytest.raises(FileNotFoundError):
        sinks.read_report(spark, path)
    sinks.write_report(rows, path, "parquet")
    reading = sinks.read_report(spark, path)
    with pytest.raises(Exception, match="broken"):  # a task fails
        sinks.write_report(rows.withColumn("a", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise("z")), path)
    assert sinks.read_report(spark, path).count() == 2
    with monkeypatch.context() as m:  # the driver dies before it publishes
        m.setattr(sinks, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sinks.write_report(rows.limit(1), path, "csv")
    assert {r.a for r in sinks.read_report(spark, path).collect()} == {"x", "y"}
    sinks.write_report(rows.limit(1), path, "csv")
    assert reading.count() == 2 and sinks.read_report(spark, path).count() == 1


def test_failures_and_rewrites(spark):
    results = spark.createDataFrame([(1, None, True, True, 0.0, 1.0, 0.2, "q"), (2, "E", True, False, None, None, None, "q"), (3, None, False, True, 1.0, 0.5, 0.1, "q")], "case_id long, error string, answerable boolean, predicted_answerable boolean, recall_20 double, citation_precision double, token_f1 double, question string")
    got = {(r.list, r.case_id) for r in reports.failures(results).collect()}
    assert got == {("error", 2), ("missed", 1), ("citation_error", 3), ("worst", 1), ("worst", 3)}
    assert [r.case_id for r in evaluation.worst(results.filter("error is null"), 1).collect()] == [3]
    failed = reports.failed_cases(results, results.filter("error is not null"), ["token_f1"]).first()
    assert (failed.case_id, failed.generated_answer, failed.rewritten_query, failed.token_f1) == (2, "", "q", None)
    flags = reports.rewrite_errors(F.col("topic_switch"), F.col("query_independent"), F.lit(True))
    raw = spark.createDataFrame([(1, None, 0.0), (2, None, 1.0), (3, "x", 1.0)], "case_id long, error string, recall_5 double")
    new = spark.createDataFrame([(1, None, 1.0, True, False), (2, None, 1.0, False, True), (3, None, 0.0, True, True)], "case_id long, error string, recall_5 double, topic_switch boolean, query_independent boolean").withColumns(flags)
    r = reports.rewrite_analysis(raw, new, (5,)).first()
    assert (r.cases, r.raw_recall_5, r.rewritten_recall_5, r.recall_delta_5, r.topic_switch_error_rate, r.unnecessary_rewrite_rate) == (2, 0.5, 1.0, 0.5, 1.0, 1.0)
    assert reports.rewrite_analysis(raw.limit(0), new, (5,)).count() == 0


def test_cursors(spark):
    docs = spark.createDataFrame([("a1", "v1", "2024-01-02 00:00:00"), ("", "v2", "2024-01-03 00:00:00")], "commit_sha string, source_version string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    value = lambda *a, **k: [r.cursor_value for r in sync.cursor_value(docs, *a, **k).collect()]
    assert value("repository_commit_sha") == ["a1"] and value("api_snapshot_at", synchronized_at="now") == ["now"]
    assert value("issues_updated_at")[0].startswith("2024-01-03T00:00:00") and value("issues_updated_at", "2024-01-03 00:00:00") == [] and len(value("issues_updated_at", "2024-01-01")) == 1
    chunks = spark.createDataFrame([(1, None, "m", 2, 5), (2, [1.0], "m", 1, 4), (3, [1.0], "n", 1, 3)], "id long, embedding array<double>, model string, dimension int, created_at int")
    assert [r.id for r in sync.needs_embedding(chunks, "m", 1).collect()] == [3, 1]


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    sync.append(rows, f"{tmp_path}/t", "id")
    assert sync.append(rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)), f"{tmp_path}/t", "id").count() == 3


def test_longest_common_subsequences():
    import random

    def table(old, new):
        n = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i in reversed(range(len(old))):
            for j in reversed(range(len(new))):
                n[i][j] = n[i + 1][j + 1] + 1 if old[i] == new[j] else max(n[i + 1][j], n[i][j + 1])
        return n

    rng = random.Random(4)
    for _ in range(300):
        old, new = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        got, n = sync.lcs(old, new), table(old, new)
        assert len(got) == n[0][0] and all(old[i] == new[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
        # ties step in the new sequence
        at = [0, 0]
        for i, j in got:
            while at != [i, j]:
                at[1 if n[at[0]][at[1] + 1] >= n[at[0] + 1][at[1]] else 0] += 1
            at = [i + 1, j + 1]
    big = sync.lcs(list(range(20_000)), [x for x in range(20_000) if x % 7])
    assert len(big) == len([x for x in range(20_000) if x % 7])


@pytest.mark.parametrize("whole", [1_000_000, 0])
def test_percentiles_and_running_sums(spark, monkeypatch, whole):
    import numpy as np

    monkeypatch.setattr(ranges, "WHOLE", whole)
    rng = np.random.default_rng(2)
    values = [(g, float(rng.integers(0, 40))) for g in "abc" for _ in range(int(rng.integers(1, 200)))] + [("d", None), ("e", 7.0)]
    rows = spark.createDataFrame(values, "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in ranges.percentiles(rows, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for g in "abce":
        own = [v for k, v in values if k == g]
        assert np.allclose(got[g], np.percentile(own, [50, 99]))
    assert "d" not in got and {r.stage: (r.n, r.p50) for r in usage.stage_latencies(rows.select(F.col("g").alias("stage"), F.col("v").alias("ms"))).collect()}["d"] == (0, 0.0)


def test_field_records_and_release_files(spark):
    rows = [(1, "apps", "v1", "Set", None, None, "Keeps pods.", None, None), (2, "apps", "v1", "Set", "A Set", "u", "How many.", "spec.replicas", "int"), (3, None, " ", "Pod", None, None, None, "spec", None)]
    records = spark.createDataFrame(rows, "position int, api_group string, version string, kind string, title string, url string, description string, field_path string, type string")
    got = {r.kind: r for r in readers.field_records(records, "base").collect()}
    assert got["Set"].text == "# A Set\n\n- API Group: `apps`\n- Version: `v1`\n- Kind: `Set`\n\nKeeps pods.\n\n## Fields\n\n### `spec.replicas` (int)\n\nHow many."
    assert got["Pod"].title == "Pod unknown core" and got["Pod"].url == "base" and got["Pod"].external_id == hashlib.sha256(b"base|core|unknown|Pod").hexdigest()[:20]
    files = spark.createDataFrame([("CHANGELOG.md", "t", "x", None)], "path string, title string, text string, updated_at timestamp")
    assert readers.release_files(files, "o/r").first().external_id == "github-release-file:o/r:CHANGELOG.md"


def test_document_types_and_fingerprints(spark):
    docs = spark.createDataFrame([("t", "c", None, "blog", "web", '{"kind": "Pod", "other": 1}'), ("t", "c", None, "blog", "web", '{"other": 2, "kind": "Pod"}'), ("t", "c", None, "blog", "web", None)], "title string, content string, canonical_url string, document_type string, source_type string, metadata string")
    a, b, c = (r.fingerprint for r in documents.document_fingerprints(docs).collect())
    want = json.dumps({"title": "t", "content": "c", "canonical_url": None, "document_type": "blog", "source_type": "web", "semantic_metadata": {"kind": "Pod"}}, sort_keys=True, separators=(",", ":"))
    assert a == b == hashlib.sha256(want.encode()).hexdigest() != c
    assert one(spark, documents.document_type(F.lit("kep"), F.lit("html")), documents.document_type(F.lit("zzz"), F.lit("GitHub_Repo")), documents.document_type(F.lit(None).cast("string"), F.lit("?"))) == ("kep", "repository_document", "official_documentation")


def test_stored_paths_are_forgotten(spark):
    from lectern.session import forget_stored

    rows = ranges.stored(spark.range(3), "x")
    assert rows.count() == 3 and spark.sparkContext._lectern_paths
    forget_stored(spark)
    assert not spark.sparkContext._lectern_paths
    with pytest.raises(Exception):
        rows.count()


def test_pages_of_messages_have_bounds(spark):
    with pytest.raises(ValueError):
        catalogue.message_page(spark.range(1), 0)


def test_metadata_containment(spark):
    rows = spark.createDataFrame([(1, '{"kind": "Pod", "n": 2, "ok": true, "api_versions": ["v1", "v2"]}'), (2, '{"kind": "Pod", "n": "2", "api_version": "v1"}'), (3, None), (4, "not json")], "id int, m string")
    hit = lambda **f: sorted(r.id for r in rows.filter(search.metadata_contains("m", f)).collect())
    assert hit(kind="Pod") == [1, 2] and hit(n=2) == [1] and hit(n=2.0) == [1] and hit(n="2") == [2] and hit(ok=True) == [1]
    assert hit(api_versions=["v1"]) == [1, 2] and hit(api_versions=["v1", "v2"]) == [1] and hit(kind="Job") == [] and hit() == [1, 2, 3, 4]


def test_hybrid_leaves_out_a_channel_that_fails(spark):
    good = spark.createDataFrame([(1, 7, 2.0, 1), (1, 8, 1.0, 2)], "query_id long, chunk_id long, score double, rank int")
    bad = lambda: good.withColumn("rank", F.raise_error(F.lit("down")).cast("int"))
    assert [r.chunk_id for r in fusion.hybrid(lambda: good, lambda: good).orderBy("fused_rank").collect()] == [7, 8]
    assert [r.chunk_id for r in fusion.hybrid(bad, lambda: good, limit=1).collect()] == [7]
    with pytest.raises(RuntimeError):
        fusion.hybrid(bad, bad)


def test_context_order(spark):
    rows = spark.createDataFrame([(1, 5, None, 2, None, None, 1), (1, 5, None, 1, None, None, 2), (1, 6, 1, 9, None, None, 3), (1, 7, None, None, 1, None, 4)], "query_id long, chunk_id long, rerank_rank int, fused_rank int, keyword_rank int, vector_rank int, position int")
    assert [(r.chunk_id, r.rank) for r in answering.context_order(rows).orderBy("rank").collect()] == [(6, 1), (5, 2), (7, 3)]


def test_token_counters(spark):
    from lectern.operators import providers

    rows = spark.createDataFrame([("a-b c!",), (None,)], "text string")
    assert [r.tokens for r in providers.token_counts(rows.limit(1)).collect()] == [3]
    assert [r.tokens for r in providers.token_counts(rows, lambda: len).collect()] == [6, 0]


def test_settings_and_prices(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"provider": "p", "model": "m", "prompt_price": 1.5, "completion_price": 2}]')
    assert readers.prices(spark, f"{tmp_path}/p.json").first().prompt_price == 1.5
    (tmp_path / "n.json").write_text('[{"provider": "p", "model": "m", "prompt_price": -1, "completion_price": 2}]')
    with pytest.raises(ValueError):
        readers.prices(spark, f"{tmp_path}/n.json")
    (tmp_path / "s.json").write_text('[{"name": "a", "source_type": "blog"}, {"name": "b", "source_type": "github_repo", "enabled": false}]')
    assert {r.name: r.enabled for r in readers.source_settings(spark, f"{tmp_path}/s.json").collect()} == {"a": True, "b": False}
    (tmp_path / "u.json").write_text('[{"name": "a", "source_type": "zzz"}]')
    with pytest.raises(ValueError):
        readers.source_settings(spark, f"{tmp_path}/u.json")
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "1", "content": "x"}\n{"chunk_id": "1", "content": "x"}\n')
    assert readers.chunk_catalog(spark, f"{tmp_path}/c.jsonl").count() == 1


def test_active_rows_batches_and_stage_means(spark):
    rows = spark.createDataFrame([(1, None, None, "active", True), (2, "x", None, "active", True), (3, None, "x", "active", True), (4, None, None, "deleted", True), (5, None, None, "active", False)], "id int, chunk_deleted_at string, document_deleted_at string, status string, source_enabled boolean")
    assert [r.id for r in search.active(rows).collect()] == [1]
    assert [len(b) for b in sync.batches(iter(range(1201)))] == [500, 500, 201] and list(sync.batches(iter(()))) == []
    means = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert usage.stage_means(means, ["a", "b"]).first() == (2.0, 0.0)


def test_claims_of_a_long_answer_take_time_in_proportion():
    import time

    from lectern.operators import answering

    text = "This is a claim [1]. " * 20_000
    began = time.process_time()
    found, told = answering.assigned(text)
    assert time.process_time() - began < 10
    assert len(found) == 20_000 and told == [(1, i) for i in range(20_000)]


def test_a_citation_report_compares_claims_and_sentences_once(spark, monkeypatch):
    from lectern.operators import answering

    stored = []
    monkeypatch.setattr(answering, "stored_copy", lambda df, label: stored.append(label) or df)
    answers = spark.createDataFrame([(1, "The cat sat here [1]. No mark here at all.")], "answer_id long, text string")
    sources = spark.createDataFrame([(1, 1, 9, 0, 20, "The cat sat here today.")], "answer_id long, number int, chunk_id long, start_offset int, end_offset int, content string")
    row = answering.citation_report(answers, sources).first()
    assert stored == ["marker-results"]
    assert (row.markers, row.precision, row.recall, row.completeness) == (1, 1.0, 0.5, 0.5)
