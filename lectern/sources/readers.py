"""Sources: repository trees, issues, releases, API definitions, evaluation sets and catalogs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File endings that hold documents. Fixed values.
SUFFIXES = ("md", "markdown", "rst", "html", "htm", "yaml", "yml", "json")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression; ``**/x`` also matches x at the root, and a pattern without a root matches from the right."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{'' if pattern.startswith('/') else '(?:.*/)?'}{out}$"


def matches(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include glob (none: all), and no exclude glob."""
    any_of = lambda globs: F.lit(False) if not globs else F.reduce(F.array(*[path.rlike(glob_regex(g)) for g in globs]), F.lit(False), lambda a, b: a | b)
    return (any_of(include) if include else F.lit(True)) & ~any_of(exclude)


def title(path: Column, text: Column) -> Column:
    """By format: first Markdown heading, underlined line, HTML title, YAML title, else the file's stem."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "[-_]", " ")
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    pick = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    found = (
        F.when(suffix.isin("md", "markdown"), pick(r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$")).when(suffix.isin("html", "htm"), pick(r"(?is)<title[^>]*>\s*(.*?)\s*</title>"))
        .when(suffix == "rst", pick(r"(?m)^(\S.*)\n[=\-~^*+#]{3,}[ \t]*$")).when(suffix.isin("yaml", "yml"), pick(r"(?m)^title:[ \t]*[\"']?(.+?)[\"']?[ \t]*$"))
    )
    return F.coalesce(found, stem)


def repository(spark: SparkSession, root: str, name: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(external_id, path, format, title, text, updated_at) of a checked-out tree, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    path = F.substring(F.col("path"), F.locate(base, F.col("path")) + len(base), F.lit(1 << 20))
    rows = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("updated_at")).filter(matches(F.col("path"), include or [], exclude or []))
    return rows.select(F.concat(F.lit(f"github:{name}:"), "path").alias("external_id"), "path", F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("format"), title(F.col("path"), F.col("text")).alias("title"), "text", "updated_at")


_ISSUE = "number long, title string, body string, state string, html_url string, created_at timestamp, updated_at timestamp, user struct<login:string>, labels array<struct<name:string>>, pull_request map<string,string>"


def issues(spark: SparkSession, path: str, repo: str, state: str = "all", pulls: bool = False, since: str | None = None, comments: DataFrame | None = None) -> DataFrame:
    """Issues of JSON pages; comments (number, author, created_at, body) follow as sections. ``since`` is inclusive."""
    rows = spark.read.schema(_ISSUE).option("multiLine", "true").json(path)
    if state != "all":
        rows = rows.filter(F.col("state") == state)
    if not pulls:
        rows = rows.filter("pull_request is null")
    if since:
        rows = rows.filter(F.col("updated_at") >= F.lit(since).cast("timestamp"))
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("body", F.lit("")))
    if comments is not None:
        sections = comments.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("created_at", "author", "body"))).alias("said"))
        rows = rows.join(sections, "number", "left")
        each = F.transform("said", lambda c: F.concat(F.lit("\n\n### @"), c["author"], F.lit(" — "), F.date_format(c["created_at"], "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("\n\n"), c["body"]))
        body = F.concat(body, F.coalesce(F.array_join(each, ""), F.lit("")))
    return rows.select(F.concat(F.lit(f"github:{repo}:issue:"), F.col("number").cast("string")).alias("external_id"), "title", body.alias("text"), F.col("html_url").alias("url"), "updated_at", F.col("state").alias("issue_state"), F.coalesce(F.transform("labels", lambda x: x["name"]), F.array().cast("array<string>")).alias("labels"))


_RELEASE = "id long, tag_name string, name string, body string, html_url string, published_at timestamp, updated_at timestamp, draft boolean, prerelease boolean"


def releases(spark: SparkSession, path: str, repo: str, drafts: bool = False, prereleases: bool = True) -> DataFrame:
    rows = spark.read.schema(_RELEASE).option("multiLine", "true").json(path)
    if not drafts:
        rows = rows.filter(~F.coalesce("draft", F.lit(False)))
    if not prereleases:
        rows = rows.filter(~F.coalesce("prerelease", F.lit(False)))
    name = F.coalesce(F.nullif("name", F.lit("")), "tag_name")
    return rows.select(F.concat(F.lit(f"github:{repo}:release:"), "tag_name").alias("external_id"), name.alias("title"), F.concat(F.lit("# "), name, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"), F.col("html_url").alias("url"), F.coalesce("updated_at", "published_at").alias("updated_at"), F.col("tag_name").alias("release_version"))


def flatten_properties(definitions: dict, name: str, depth: int = 8) -> list[tuple[str, str, str]]:
    """(dotted path, type, description) of a definition's properties, through references, without cycles, to ``depth``."""
    out: list[tuple[str, str, str]] = []

    def walk(schema: dict, path: str, level: int, seen: frozenset) -> None:
        ref = schema.get("$ref", "").rpartition("/")[2]
        if ref:
            if ref in seen or ref not in definitions:
                return
            schema, seen = definitions[ref], seen | {ref}
        if level >= depth:
            return
        for key, value in schema.get("properties", {}).items():
            target = value.get("items", {}) if value.get("type") == "array" else value
            kind = value.get("type") or target.get("$ref", "").rpartition("/")[2] or "object"
            out.append((f"{path}.{key}" if path else key, kind, value.get("description", "")))
            walk(target, out[-1][0], level + 1, seen)

    walk(definitions.get(name, {}), "", 0, frozenset({name}))
    return out


def api_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, group, version, kind, fields) of an OpenAPI file's definitions that name their kind, by rows of definitions."""
    import json

    from pyspark.sql import types as T

    field = T.StructType().add("path", "string").add("type", "string").add("description", "string")
    schema = T.StructType().add("group", "string").add("version", "string").add("kind", "string").add("fields", T.ArrayType(field))

    @F.udtf(returnType=schema)
    class Definitions:
        def eval(self, text: str):
            every = json.loads(text).get("definitions", {})
            for name, value in every.items():
                for gvk in value.get("x-kubernetes-group-version-kind", []) or ([dict(zip(("group", "version", "kind"), name.rpartition(".api.")[2].split("."), strict=False))] if ".api." in name else []):
                    yield gvk.get("group") or "core", gvk.get("version") or "unknown", gvk.get("kind") or name, flatten_properties(every, name)

    spark.udtf.register("api_definitions", Definitions)
    files = spark.read.text(path, wholetext=True)
    files.createOrReplaceTempView("_api_files")
    rows = spark.sql("SELECT d.* FROM _api_files, LATERAL api_definitions(value) d")
    return rows.withColumn("external_id", F.substring(F.sha2(F.concat_ws("|", F.lit(path), "group", "version", "kind"), 256), 1, 20))


def field_records(records: DataFrame, source_url: str | None = None) -> DataFrame:
    """(external_id, group, version, kind, title, url, text, field_paths) of API field records, one document for each group, version and kind.

    ``records`` has (position, api_group, version, kind, title, url, description, field_path, type). A record without a path
    describes the kind; title and URL are those of the last record.
    """
    word = lambda c, none: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(none))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = records.select("position", word("api_group", "core").alias("group"), word("version", "unknown").alias("version"), word("kind", "UnknownKind").alias("kind"), text("title").alias("title"), text("url").alias("url"), text("description").alias("description"), text("field_path").alias("path"), text("type").alias("type"))
    rows = rows.withColumn("title", F.coalesce("title", F.concat_ws(" ", "kind", "version", "group")))
    fields = F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("position", "path", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description")))))
    notes = F.array_sort(F.collect_list(F.when(F.col("path").isNull() & F.col("description").isNotNull(), F.struct("position", "description"))))
    made = rows.groupBy("group", "version", "kind").agg(F.max_by("title", "position").alias("title"), F.max_by("url", "position").alias("url"), fields.alias("fields"), notes.alias("notes"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n- API Group: `"), "group", F.lit("`\n- Version: `"), "version", F.lit("`\n- Kind: `"), "kind", F.lit("`"))
    said = F.array_join(F.transform("notes", lambda n: n["description"]), "\n\n")
    note = F.when(F.size("notes") > 0, F.concat(F.lit("\n\n"), said)).otherwise("")
    one = lambda f: F.concat(F.lit("### `"), f["path"], F.lit("`"), F.when(f["type"] != "", F.concat(F.lit(" ("), f["type"], F.lit(")"))).otherwise(""), F.when(f["description"] != "", F.concat(F.lit("\n\n"), f["description"])).otherwise(""))
    listed = F.when(F.size("fields") > 0, F.concat(F.lit("\n\n## Fields\n\n"), F.array_join(F.transform("fields", one), "\n"))).otherwise("")
    url = F.coalesce("url", F.lit(source_url))
    name = F.substring(F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), "group", "version", "kind"), 256), 1, 20)
    return made.select(name.alias("external_id"), "group", "version", "kind", "title", url.alias("url"), F.concat(head, note, listed).alias("text"), F.transform("fields", lambda f: f["path"]).alias("field_paths"))


def release_files(files: DataFrame, repo: str) -> DataFrame:
    """Documents of ``repository`` as release notes, for changelogs that are kept as files."""
    return files.select(F.concat(F.lit(f"github-release-file:{repo}:"), "path").alias("external_id"), "title", "text", F.lit(None).cast("string").alias("url"), "updated_at", F.lit(None).cast("string").alias("release_version"))


_CASE = "id string, question string, reference_answer string, category string, difficulty string, answerable boolean, relevant_chunk_ids array<string>, expected_citations array<string>"


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines evaluation set; malformed lines, repeated ids and an empty set are errors."""
    rows = spark.read.schema(_CASE).option("mode", "FAILFAST").json(path)
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an evaluation set repeats an id")
    if rows.limit(1).count() == 0:
        raise ValueError("an evaluation set is empty")
    return rows


_CHUNK = "chunk_id string, document_id string, chunk_index int, title string, section string, document_type string, content string"


def chunk_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines catalog of source chunks; malformed lines are errors, and of rows that repeat an id one stays."""
    return spark.read.schema(_CHUNK).option("mode", "FAILFAST").json(path).dropDuplicates(["chunk_id"])


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(provider, model, prompt_price, completion_price) per million tokens, of a JSON list; a negative price is an error."""
    rows = spark.read.schema("provider string, model string, prompt_price decimal(18,8), completion_price decimal(18,8)").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if rows.filter("prompt_price < 0 or completion_price < 0").limit(1).count():
        raise ValueError("a price is negative")
    return rows


_SOURCE = "name string, source_type string, enabled boolean, include array<string>, exclude array<string>, options map<string,string>"


def source_settings(spark: SparkSession, path: str) -> DataFrame:
    """Source configurations of a JSON list, enabled unless they say not; unknown types and repeated names are errors."""
    rows = spark.read.schema(_SOURCE).option("multiLine", "true").option("mode", "FAILFAST").json(path).withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    if rows.filter(~F.coalesce(F.col("source_type").isin(*LOADERS), F.lit(False))).limit(1).count():
        raise ValueError("a source's type is unknown")
    if rows.groupBy("name").count().filter("count > 1").limit(1).count():
        raise ValueError("a source's name is repeated")
    return rows


def catalog_sample(catalog: DataFrame, n: int, seed: int = 20250717) -> DataFrame:
    """``n`` rows of least seeded hash, the same on every run."""
    return catalog.orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(n)


#: How each kind of source is synced: whether a scan sees everything, and its cursor. Fixed values.
LOADERS = {"github_repo": (True, "commit"), "github_issues": (False, "updated_at"), "release_notes": (True, "updated_at"), "api_reference": (True, "content_hash"), "blog": (True, "content_hash")}


def loader(source_type: str, previous_cursor: str | None = None) -> dict:
    """The loader's contract; a scan of issues that has a cursor sees changes only, so it never deletes."""
    complete, cursor = LOADERS[source_type]
    return {"complete_snapshot": complete or (source_type == "github_issues" and previous_cursor is None), "cursor_type": cursor}
