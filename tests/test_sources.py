import json

import pytest

from lectern.sources import readers, sinks


def test_globs():
    import re

    assert re.match(readers.glob_regex("**/x.md"), "x.md") and re.match(readers.glob_regex("docs/*.md"), "a/docs/b.md") and not re.match(readers.glob_regex("docs/*.md"), "docs/a/b.md")


def test_repository(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a-b.md").write_text("# Head one\ntext")
    (tmp_path / "docs/c_d.txt").write_text("no")
    (tmp_path / "e-f.yaml").write_text("k: v\n")
    got = {r.path: (r.title, r.format) for r in readers.repository(spark, str(tmp_path), "o/r").collect()}
    assert got == {"docs/a-b.md": ("Head one", "md"), "e-f.yaml": ("e f", "yaml")}
    assert readers.repository(spark, str(tmp_path), "o/r", exclude=["**/*.md"]).count() == 1


def test_issues_and_releases(spark, tmp_path):
    issue = {"number": 1, "title": "t", "body": "b", "state": "open", "labels": [{"name": "bug"}], "updated_at": "2024-01-02T00:00:00Z"}
    (tmp_path / "i.json").write_text(json.dumps([issue, issue | {"number": 2, "pull_request": {"url": "u"}}, issue | {"number": 3, "updated_at": "2023-01-01T00:00:00Z"}]))
    rows = readers.issues(spark, str(tmp_path / "i.json"), "o/r", since="2024-01-02 00:00:00").collect()
    assert [r.external_id for r in rows] == ["github:o/r:issue:1"] and rows[0].labels == ["bug"]
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "tag_name": "v1", "draft": False}, {"id": 2, "tag_name": "v2", "draft": True}]))
    assert [r.title for r in readers.releases(spark, str(tmp_path / "r.json"), "o/r").collect()] == ["v1"]


def test_api_definitions(spark, tmp_path):
    spec = {"definitions": {"io.api.apps.v1.Thing": {"properties": {"spec": {"$ref": "#/definitions/Spec"}}}, "Spec": {"properties": {"n": {"type": "integer"}, "again": {"$ref": "#/definitions/Spec"}}}}}
    (tmp_path / "a.json").write_text(json.dumps(spec))
    row = readers.api_definitions(spark, str(tmp_path / "a.json")).first()
    assert (row.group, row.version, row.kind) == ("apps", "v1", "Thing") and [f.path for f in row.fields] == ["spec", "spec.n", "spec.again"] and len(row.external_id) == 20


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id": "a", "question": "q"}\n\n{"id": "a", "question": "r"}\n')
    with pytest.raises(ValueError):
        readers.evaluation_cases(spark, str(tmp_path / "e.jsonl"))


def test_fingerprints_ignore_order(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(20)], "id long, x string")
    assert sinks.fingerprint(rows).first() == sinks.fingerprint(rows.orderBy(rows.id.desc())).first()
    assert sinks.fingerprint(rows).first().fingerprint != sinks.fingerprint(rows.filter("id > 0")).first().fingerprint


def test_reference_pages(spark):
    from lectern.operators import api_pages

    table = "<table><tr><th>Field</th><th>Description</th><th>Type</th></tr><tr data-field-path='spec.x'><td>x</td><td>How <b>many</b></td><td>int</td></tr><tr><td>`y`</td><td></td><td></td></tr></table>"
    marked = f"<title>T</title><body><div data-kind='Pod' data-version='v1' id='pod'><h2>The pod</h2><p>Runs.{table}</div><div data-kind='Job' data-group='batch'><h2>Jobs</h2></div></body>"
    a, b = api_pages.documents(marked, "u")
    assert a[1:6] == ("core", "v1", "Pod", "The pod", "u#pod") and a[7] == ["spec.x", "y"] and "### `spec.x` (int)\n\nHow many" in a[6]
    assert b[1:5] == ("batch", "unknown", "Job", "Jobs")
    plain = "<body><main><h1>API</h1><h2 id='a'>Pod v1 core</h2><p>one</p><h3>More</h3><p>two</p><h2>Set v1beta1 apps</h2><p>three</p></main></body>"
    one, two = api_pages.documents(plain, "u")
    assert one[1:4] == ("core", "v1", "Pod") and "two" in one[6] and "three" not in one[6] and two[1:4] == ("apps", "v1beta1", "Set") and one[5] == "u#a"
    assert api_pages.documents("<meta name='api-kind' content='Node'><body><p>x</body>", "u")[0][3] == "Node" and api_pages.documents("", "u") == []
    rows = api_pages.reference_pages(spark.createDataFrame([(1, "u", marked), (2, None, None), (3, "u", plain)], "page_id long, url string, html string")).collect()
    assert [r.page_id for r in rows] == [1, 1, 3, 3] and len({r.external_id for r in rows}) == 4
