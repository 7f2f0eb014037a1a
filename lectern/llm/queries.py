"""One query for each operator of the corpus pipeline, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, exact, fingerprint, lm, names, neardup, quality, ranked, substrings, suffixes, toxicity, warc
from lectern.llm.common import configured, fold, table


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured(spark)
    return exact.report(spark, f"{sf_dir}/documents.parquet")


def op12_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.join(table(spark, sf_dir, "clients"), table(spark, sf_dir, "vendors"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_cnn, op2_suffix_array, op3_quality_rules, op4_language_model, op5_byte_bpe, op6_warc, op7_near_duplicates, op8_decontaminate, op9_substring_dedup, op10_fingerprint, op11_exact_dedup, op12_name_join, op13_ranked_search)}


_COVER = """e AS (SELECT doc_id, j, sum(d) AS d FROM (SELECT doc_id, i AS j, 1 AS d FROM hits UNION ALL SELECT doc_id, i + n, -1 FROM hits) GROUP BY 1, 2),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM t),
marked AS (SELECT doc_id, j, word, sum(coalesce(d, 0)) OVER (PARTITION BY doc_id ORDER BY j) > 0 AS hit FROM words LEFT JOIN e USING (doc_id, j))"""

# bytes as pairs of hexadecimal digits; a string of 100 bytes is a repeat unless it is the first by (doc_id, start)
OP2_SQL = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), o AS (SELECT doc_id, 100 * k AS origin, substr(h, 200 * k + 1, 398) AS p FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 1) // 100 + 1)) AS k FROM t WHERE len(h) >= 200)),
v AS (SELECT doc_id, origin + i AS i, substr(p, 2 * i - 1, 200) AS key FROM (SELECT doc_id, origin, p, unnest(range(1, 101)) AS i FROM o) WHERE 2 * i + 198 <= len(p)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM v), hits AS (SELECT doc_id, i FROM g WHERE n > 1),
e AS (SELECT doc_id, j, sum(d) AS d FROM (SELECT doc_id, i AS j, 1 AS d FROM hits UNION ALL SELECT doc_id, i + 100, -1 FROM hits) GROUP BY 1, 2),
b AS (SELECT doc_id, origin + j AS j, substr(p, 2 * j - 1, 2) AS byte FROM (SELECT doc_id, origin, p, unnest(range(1, least(len(p) // 2, 100) + 1)) AS j FROM (SELECT doc_id, 100 * k AS origin, substr(h, 200 * k + 1, 200) AS p FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 1) // 100 + 1)) AS k FROM t WHERE h <> '')))),
m AS (SELECT doc_id, j, byte, coalesce(sum(d) OVER (PARTITION BY doc_id ORDER BY j), 0) > 0 AS hit FROM b LEFT JOIN e USING (doc_id, j)),
r AS (SELECT *, hit AND NOT coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY j), false) AS first FROM m),
k AS (SELECT doc_id, count(*) FILTER (hit) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(byte, '' ORDER BY j) FILTER (NOT hit) AS kept FROM r GROUP BY 1)
SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(sha, i, 1))]), '') AS bits FROM h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

_OP8_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""WITH t AS (SELECT doc_id, {_OP8_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP8_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, key)), hits AS (SELECT DISTINCT doc_id, i, n FROM found), {_COVER},
x AS (SELECT doc_id, count(*) FILTER (hit) AS n_hit FROM marked GROUP BY 1), y AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM found GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM t LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""

OP9_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), v AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
c AS (SELECT key FROM v GROUP BY 1 HAVING count(*) > 1), hits AS (SELECT doc_id, i, 35 AS n FROM v SEMI JOIN c USING (key)), {_COVER},
k AS (SELECT doc_id, count(*) FILTER (hit) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT hit) AS kept FROM marked GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""


OP11_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)"""

# crc32 digit by digit; the distance row by row: s is the row before, p the one before that, both with the cell of no code points first
_CRC = "xor(list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, d: list_reduce([xor(c, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), CAST(4294967295 AS BIGINT)), 4294967295)"
OP12_SQL = f"""WITH RECURSIVE v AS (SELECT vendor_id, name, length(name) AS n, {_CRC.format("vendor_id")} AS h FROM vendors WHERE name <> ''),
a AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND n >= 2 THEN substr(name, 1, CAST(h % (n - 1) AS INT)) || substr(name, CAST(h % (n - 1) AS INT) + 2, 1) || substr(name, CAST(h % (n - 1) AS INT) + 1, 1) || substr(name, CAST(h % (n - 1) AS INT) + 3) ELSE name END AS asked FROM v),
c AS (SELECT name, count(*) AS k, min(client_id) AS first_id, sum({_CRC.format("client_id")}) AS crc FROM clients WHERE name <> '' GROUP BY 1),
pairs AS (SELECT DISTINCT asked, name FROM a, c WHERE abs(length(asked) - length(name)) <= 2),
d AS (SELECT asked, name, 0 AS i, CAST(range(0, length(asked) + 1) AS INT[]) AS s, CAST([] AS INT[]) AS p FROM pairs
UNION ALL SELECT asked, name, i + 1, list_reduce(range(1, length(asked) + 1), lambda r, j: list_append(r, CAST(least(r[-1] + 1, s[j + 1] + 1, s[j] + CASE WHEN substr(asked, j, 1) = substr(name, i + 1, 1) THEN 0 ELSE 1 END,
CASE WHEN i > 0 AND j > 1 AND substr(asked, j, 1) = substr(name, i, 1) AND substr(asked, j - 1, 1) = substr(name, i + 1, 1) THEN p[j - 1] + 1 ELSE 99 END) AS INT)), [CAST(i + 1 AS INT)]), s FROM d WHERE i < length(name) AND list_min(s) <= 2),
near AS (SELECT asked, name, s[-1] AS distance FROM d WHERE i = length(name) AND s[-1] <= 2)
SELECT vendor_id, distance, CAST(sum(k) AS BIGINT) AS n_clients, min(first_id) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc FROM a JOIN near USING (asked) JOIN c USING (name) GROUP BY 1, 2"""

_OP13_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH t AS (SELECT doc_id, {_OP13_TERMS} AS w FROM documents), s AS (SELECT count(*) AS cn, sum(len(w)) AS cl FROM t WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_OP13_TERMS}) AS term FROM benchmark), d AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(cn) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY 1),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // CAST(cl AS BIGINT))))) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are held against brute force in the tests."""
    return {"op2_suffix_array": OP2_SQL, "op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_name_join": OP12_SQL, "op13_ranked_search": OP13_SQL}
