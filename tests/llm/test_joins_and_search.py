"""Streaming exact dedup, the edit-distance join and ranked search against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact, names, ranked
from lectern.session import stored_path

# --- exact dedup ---


def placed(spark, rows, schema="doc_id long, text string", files=3):
    path = stored_path(spark, "files")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return path


def brute_groups(rows):
    out = []
    for d, t in rows:
        same = [x for x, u in rows if (u or "") == (t or "")]
        keep = max((x for x in same if x is not None), default=None)
        out.append((d, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 7}") for i in range(40)] + [(100, None), (101, ""), (None, "text 1"), (None, "alone"), (102, "ünï \U0001f600"), (7, "text 0")]


def columns(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_exact_groups(spark):
    got = exact.report(spark, placed(spark, ROWS))
    assert columns(got) == brute_groups(ROWS)
    kept = got.filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == got.select("text_sha256").distinct().count()


@pytest.mark.parametrize("digest", [lambda t: F.lit("same"), lambda t: F.crc32(t) % 3])
def test_whole_texts_decide_where_digests_agree(spark, digest):
    got = exact.report(spark, placed(spark, ROWS), digest=digest)
    assert columns(got) == brute_groups(ROWS)
    assert got.filter("kept").count() == got.select("text_sha256").distinct().count()


def test_repeated_rows_keep_one(spark):
    got = exact.report(spark, placed(spark, [(5, "a")] * 6 + [(4, "a"), (4, "b")])).collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept] in ([(5, 5, 7), (4, 4, 1)], [(4, 4, 1), (5, 5, 7)])


def test_a_restarted_stream_reads_new_files_only(spark):
    path, checkpoint = placed(spark, ROWS, files=2), stored_path(spark, "state")
    exact.ingest(spark, path, checkpoint)
    assert exact.ingest(spark, path, checkpoint).lastProgress is None or exact.ingest(spark, path, checkpoint).lastProgress["numInputRows"] == 0
    more = [(200, "text 3"), (201, "new"), (-5, "text 2")]
    spark.createDataFrame(more, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    query = exact.ingest(spark, path, checkpoint)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    assert columns(exact.members(spark, path, checkpoint)) == brute_groups(ROWS + more)


def test_exact_dedup_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    path = stored_path(spark, "odd")
    odd.write.parquet(path)
    assert columns(exact.report(spark, path)) == brute_groups(rows)
    kept = exact.kept(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in rows})
    none = stored_path(spark, "none")
    odd.limit(0).write.parquet(none)
    assert exact.report(spark, none).count() == 0 and exact.kept(odd.limit(0)).count() == 0
    text_ids = exact.report(spark, placed(spark, [("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")).collect()
    assert {r.keep_id for r in text_ids} == {"b"}


# --- names ---


def osa(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def misspelt(name, vendor):
    h, s = zlib.crc32(str(vendor if vendor is not None else "").encode()), list(name)
    if h % 2 == 0 and len(s) > 1:
        p = h % (len(s) - 1)
        s[p], s[p + 1] = s[p + 1], s[p]
    return "".join(s)


def brute_join(clients, vendors, limit=2):
    out = {}
    for v, name in vendors:
        if name:
            asked = misspelt(name, v)
            for c, other in clients:
                if other and (x := osa(asked, other)) <= limit:
                    n, first, crc = out.get((v, x), (0, None, 0))
                    out[v, x] = n + 1, c if first is None else first if c is None else min(first, c), crc + zlib.crc32(str("" if c is None else c).encode())
    return out


def joined(spark, clients, vendors, **more):
    made = names.join(spark.createDataFrame(clients, "client_id long, name string"), spark.createDataFrame(vendors, "vendor_id long, name string"), **more)
    rows = made.collect()
    assert len({(r.vendor_id, r.distance) for r in rows}) == len(rows)
    return {(r.vendor_id, r.distance): (r.n_clients, r.first_client_id, r.clients_crc) for r in rows}


def some_names(rng, n, letters, longest):
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))) for _ in range(n)]
    for i in range(n // 2):  # and words a few edits away
        s = list(rng.choice(made))
        for _ in range(rng.randrange(4)):
            p, kind = rng.randrange(len(s) + 1), rng.randrange(4)
            if kind == 0:
                s.insert(p, rng.choice(letters))
            elif p < len(s) and kind == 1 and len(s) > 1:
                del s[p]
            elif p < len(s) and kind == 2:
                s[p] = rng.choice(letters)
            elif p + 1 < len(s):
                s[p], s[p + 1] = s[p + 1], s[p]
        made.append("".join(s))
    return made


@pytest.mark.parametrize(("letters", "longest", "piece"), [("ab", 9, 4000), ("abcß漢\U0001f600 ", 14, 4000), ("abcdefghij", 22, 3)])
def test_name_join_equals_brute_force(spark, monkeypatch, letters, longest, piece):
    rng = random.Random(longest)
    if piece < 10:
        monkeypatch.setattr(names, "ASKED", 2)
    pool = some_names(rng, 120, letters, longest)
    clients = [(i, rng.choice(pool)) for i in range(150)] + [(None, pool[0]), (3, pool[1]), (900, None), (901, "")]
    vendors = [(i, rng.choice(pool)) for i in range(70)] + [(None, pool[0]), (5, pool[2]), (6, ""), (7, None)]
    assert joined(spark, clients, vendors, piece=piece) == brute_join(clients, vendors)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_name_join_with_other_limits(spark, limit):
    rng = random.Random(limit)
    pool = some_names(rng, 60, "abc", 12)
    clients, vendors = [(i, n) for i, n in enumerate(pool)], [(i, n) for i, n in enumerate(pool[::-1][:40])]
    assert joined(spark, clients, vendors, limit=limit) == brute_join(clients, vendors, limit)


def test_name_join_of_very_long_repeated_and_no_rows(spark):
    long = "lang" * 2000
    clients = [(1, long), (2, long + "x"), (3, long[:-3]), (1, long), (4, " ")]
    vendors = [(1, long), (1, long), (9, "  ")]
    assert joined(spark, clients, vendors) == brute_long(clients, vendors)
    assert joined(spark, clients, vendors[:0]) == {} == joined(spark, clients[:0], vendors)
    clash = spark.createDataFrame([(1, "abc", 1, 2, "k")], "client_id long, name string, n int, distance int, part string")
    assert names.join(clash, spark.createDataFrame([(1, "abc", 3, "s")], "vendor_id long, name string, m int, seg string")).count() == 1


def brute_long(clients, vendors):
    """Only ends differ in the long names, so what they share at both ends is left out of the comparison, but for a margin."""
    out = {}
    for v, name in vendors:
        asked = misspelt(name, v)
        for c, other in clients:
            if abs(len(asked) - len(other)) > 2:
                continue
            a, b = asked, other
            while len(a) > 12 and len(b) > 12 and a[:6] == b[:6]:
                a, b = a[1:], b[1:]
            while len(a) > 12 and len(b) > 12 and a[-6:] == b[-6:]:
                a, b = a[:-1], b[:-1]
            if (x := osa(a, b)) <= 2:
                n, first, crc = out.get((v, x), (0, c, 0))
                out[v, x] = n + 1, min(first, c), crc + zlib.crc32(str(c).encode())
    return out


def test_misspelling(spark):
    rows = spark.createDataFrame([(i, n) for i in range(60) for n in ("a", "ab", "漢ß\U0001f600d")], "vendor_id long, name string")
    made = rows.select("vendor_id", "name", names.misspelt(F.col("name"), F.col("vendor_id")).alias("x")).collect()
    assert all(r.x == misspelt(r.name, r.vendor_id) for r in made) and any(r.x != r.name for r in made)


# --- ranked search ---


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, k):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in bags:
            tf, score = Counter(w), 0
            for t in set(terms(text)):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * (50 + 50 * len(w) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, d is not None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"shard": 1000, "block": 3}, {"known_terms": 2}])
def test_ranked_search_equals_brute_force(spark, prose, more):
    docs = [*enumerate(prose), (500, prose[3]), (400, prose[3]), (401, None), (402, ""), (403, " .,; "), (404, "ÄÖ Straße ÄÖ 漢字 A1")]
    items = [(i, " ".join(prose[i].split()[:25])) for i in range(0, 60, 7)] + [(90, "straße äÖ ÄÖ a1 LAN"), (91, None), (92, "!!"), (93, "nowhere"), (94, prose[3])]
    made = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=10, **more)
    assert found(made) == brute_ranks(docs, items, 10)


def test_ranked_search_of_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "plain WORDS id"), (2, "wort1 wort2 ende text"), (2, "text"), (None, "ende")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, rank int")
    got = found(ranked.search(odd, asked, k=3))
    assert got == brute_ranks(docs, items, 3) and any(g[2] is None for g in got)
    assert ranked.search(odd.limit(0), asked).count() == 0 == ranked.search(odd, asked.limit(0)).count()
    assert ranked.search(odd.select("doc_id", F.lit(None).cast("string").alias("text")), asked).count() == 0


def test_search_stops_early_with_whole_scores():
    """Random shards: the best k are those of complete scores, though few postings of common terms are added."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, v = 3000, 12
        bags = [np.flatnonzero(rng.random(v) < np.linspace(0.01, 0.9, v)) for _ in range(n)]
        ends = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        term, tf = np.concatenate(bags), rng.integers(1, 5, int(ends[-1]))
        shard = ranked.Shard(50 + rng.integers(1, 400, n), ends, term, tf, v)
        weights = (1000 * np.log(2 / np.linspace(0.01, 0.9, v))).astype(np.int64)
        query = rng.permutation(v)[: rng.integers(1, v)]
        docs, scores = shard.best(query, weights[query], 10, np.arange(n))
        whole = shard.whole(np.arange(n), query, weights[query])
        order = np.lexsort((np.arange(n), -whole))[:10]
        order = order[whole[order] > 0]
        assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
