"""Stored indexes: postings, trigram sets and vector cells, against scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.english import EXCEPTIONS, stem
from lectern.operators import cells, grams, keywords, postings, search
from lectern.operators import scan as texts

#: Pairs of the stemmer's published sample vocabulary.
STEMS = """consigned consign consistency consist consolatory consolatori consolingly consol conspiracy conspiraci knackeries knackeri knightly knight
knitting knit hopping hop hoping hope relational relat conditional condit sensibility sensibl formative format electricity electr adjustment adjust generically generic
communism communism ties tie cries cri gas gas gaps gap dying die skies sky news news inning inning proceed proceed succeed succeed luxuriated luxuri happily happili
digitizer digit analogies analog replacement replac adoption adopt controlling control agreed agre feed feed boyish boyish sayings say yes yes""".split()


def test_stems():
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2], strict=True))


def scan(docs, asked):
    """Scores of every chunk, from its text."""
    out = set()
    for q, query in asked:
        arms = postings.arms(query)
        for d, title, text in docs:
            at, offset = {}, 0
            for words, c in ((postings.words(title), 3), (postings.words(text), 1)):
                kept = [(i, t) for i, w in enumerate(words, 1) if (t := postings.term_of(w)) is not None]
                for i, t in kept:
                    at.setdefault(t, []).append(4 * (offset + i) + c)
                offset += kept[-1][0] if kept else 0
            for i, w in enumerate(postings.words(text), 1):
                at.setdefault(w, []).append(4 * (offset + i))
            near = lambda p: bool(postings._occurrences(at, p)[0])
            if any(all(map(near, w.phrases)) and not any(map(near, w.banned)) for arm in arms for w in arm):
                a, b = (postings.scaled(postings.density(at, arm)) for arm in arms)
                out.add((q, d, round(max(a, 0.75 * b), 6)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = "deploy deployed deployments running runs pod pods the of volume volumes scale scaling k8s straße ÄRA".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(3) if i % 3 else None, text(rng.randrange(0, 40)) if i % 11 else None) for i in range(150)]
    asked = [(1, "deployments running"), (2, '"running pods" or volume'), (3, "scaling -pod"), (4, "the"), (5, "ära STRASSE straße"), (6, 'pods "deployed the volume"'), (7, "absent"), (8, "")]
    return docs, asked


@pytest.mark.parametrize("known", [1 << 18, 3])
def test_texts_are_searched_without_an_index(spark, corpus, monkeypatch, known):
    docs, asked = corpus
    monkeypatch.setattr(texts, "KNOWN", known)
    monkeypatch.setattr(texts, "LONGEST", 64 if known > 3 else 5)
    monkeypatch.setattr(postings, "create", lambda *_: pytest.fail("an index was made"))
    chunks = spark.createDataFrame(docs, "chunk_id long, title string, text string")
    queries = spark.createDataFrame([*asked, (9, None)], "query_id long, text string")
    got = lambda k: {(r.query_id, r.chunk_id, r.score) for r in search.top_k(keywords.dense_in_texts(queries, chunks, k), k).collect()}
    assert got(200) == scan(docs, asked)
    ranked = {}
    for q, d, s in scan(docs, asked):
        ranked.setdefault(q, []).append((-s, d))
    assert got(3) == {(q, d, -s) for q, rows in ranked.items() for s, d in sorted(rows)[:3]}
    # one task's running best, whose bound leaves out what can't reach it
    block = texts._Asked(asked, ["title", "text"], 3, False)
    for d, title, text in docs:
        block.add(d, [(title or "").lower(), (text or "").lower()])
    assert {(q, -d, s) for q, best in block.best.items() for s, d in best} == got(3)
    assert keywords.keyword_top_k(queries, chunks, 3).count() > 0


def test_texts_and_index_agree(spark, corpus):
    """A context of its own, words alone, and more queries than a block, which go by an index."""
    docs, asked = corpus
    chunks = spark.createDataFrame([(d, title, text, f"{title} {d % 5} pods") for d, title, text in docs], "chunk_id long, title string, text string, context string")
    queries = spark.createDataFrame([*asked, (10, "pods 3"), (11, "and the")], "query_id long, text string")
    got = lambda rows: {(r.query_id, r.chunk_id, r.score) for r in search.top_k(rows, 5).collect()}
    for words_only in (False, True):
        held = got(postings.search(queries, postings.create(chunks), 5, words_only=words_only))
        assert held and got(keywords.dense_in_texts(queries, chunks, 5, words_only)) == held == got(keywords.dense_in_texts(queries, chunks, 5, words_only, split=4))


def test_stems_begin_as_their_words():
    """What the search of texts leaves unstemmed has none of the stems asked for."""
    ends = ["", *"sye", "ed", "ing", "ies", "ingly", "eedly", "ll", "ational", "fulness", "iviti", "biliti", "ousli", "izer", "li", "ness", "ement"]
    made = {a + b + c + d for a in ("", *"aeibty") for b in ("", *"aeibtlsy") for c in ends for d in ends} | {*STEMS[::2], *EXCEPTIONS}
    for word in filter(None, made):
        assert texts._Held({stem(word)})._stem(word) == postings.term_of(word)


@pytest.mark.parametrize("small", [False, True])
def test_index_equals_a_scan(spark, corpus, monkeypatch, small):
    docs, asked = corpus
    if small:  # many blocks, so that bounds and slices count
        monkeypatch.setattr(postings, "BLOCK", 5)
        monkeypatch.setattr(postings, "FIRST", 2)
        monkeypatch.setattr(postings, "SLICE", 3)
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, title string, text string")
    queries = spark.createDataFrame([*asked, (9, None)], "query_id long, text string")
    got = lambda path, k=200, **more: {(r.query_id, r.chunk_id, r.score) for r in keywords.density_top_k(queries, path, k, **more).collect()}
    path = postings.create(frame(docs[:100]), buckets=4)
    assert got(path) == scan(docs[:100], asked)
    ranked = {}
    for q, d, s in scan(docs[:100], asked):
        ranked.setdefault(q, []).append((-s, d))
    assert got(path, 3) == {(q, d, -s) for q, rows in ranked.items() for s, d in sorted(rows)[:3]}
    # appended chunks, of which some are there already, and removed ones
    changed = [(5, "pods", "volume scaling"), (6, None, "running")]
    postings.append(frame(docs[100:] + changed), path)
    now = [d for d in docs if d[0] not in (5, 6)] + changed
    assert got(path) == scan(now, asked)
    postings.remove(spark.createDataFrame([(7,), (120,), (9999,)], "chunk_id long"), path)
    now = [d for d in now if d[0] not in (7, 120)]
    assert got(path) == scan(now, asked)
    some = [d for d in now if d[0] % 2]
    assert got(path, among=frame(some)) == scan(some, asked)


def test_no_text_is_read_by_a_search(spark, corpus, tmp_path):
    docs, asked = corpus
    at = str(tmp_path / "chunks")
    spark.createDataFrame(docs, "chunk_id long, title string, text string").write.parquet(at)
    path = postings.create(spark.read.parquet(at))
    import shutil

    shutil.rmtree(at)
    assert keywords.density_top_k(spark.createDataFrame(asked, "query_id long, text string"), path).count() > 0
    empty = postings.create(spark.createDataFrame([], "chunk_id long, text string"))
    assert keywords.density_top_k(spark.createDataFrame(asked, "query_id long, text string"), empty).count() == 0


def gram_set(text):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(len(w) + 1)}


@pytest.mark.parametrize(("threshold", "split"), [(0.3, 200_000), (0.3, 5), (0.7, 200_000), (1.0, 3)])
def test_similar_trigram_sets(spark, threshold, split):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcß漢") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 8)))
    docs, asked = [(i, text()) for i in range(120)] + [(200, None), (201, "")], [(i, text()) for i in range(25)] + [(90, None), (91, "..")]
    asked += [(92, docs[3][1]), (93, docs[4][1] + " abc")]
    got = {(r.query_id, r.chunk_id): r.score for r in grams.similar(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string"), threshold, split=split).collect()}
    want = {}
    for q, a in asked:
        for d, b in docs:
            x, y = gram_set(a), gram_set(b)
            if x and y and (s := round(len(x & y) / len(x | y), 6)) >= threshold:
                want[q, d] = s
    assert got == pytest.approx(want) and want


def clustered(n, size, seed=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(7).normal(size=(40, size))
    return [(i, (middles[rng.integers(40)] + 0.03 * rng.normal(size=size)).tolist()) for i in range(n)]


def test_vector_cells(spark):
    rows = clustered(1500, 16) + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in clustered(40, 16, 1)] + [(99, None)], "query_id long, embedding array<float>")
    want = {(r.query_id, r.chunk_id, r.score) for r in search.vector_top_k(queries, chunks, 10).collect()}
    path = cells.create(chunks.filter("chunk_id < 1000 or chunk_id > 4999"), 16)
    cells.append(chunks.filter("chunk_id between 1000 and 4999"), path)
    found = lambda rows: {(r.query_id, r.chunk_id, r.score) for r in rows}
    exact = cells.search(queries, path, 10, exact=True).collect()
    assert found(exact) == want and all(r.proved for r in exact)
    near = cells.search(queries, path, 10).collect()
    assert len(found(near) & want) >= 0.9 * len(want)
    # what is said to be proved is right
    for r in near:
        assert not r.proved or (r.query_id, r.chunk_id, r.score) in want
    assert any(r.proved for r in near)


def test_vector_cells_of_hot_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLICE", 20)
    monkeypatch.setattr(cells, "QUERY_SLICE", 3)
    same = [(i, [1.0, 2.0]) for i in range(90)] + [(100, [2.0, 1.0]), (101, [-1.0, 0.5])]
    chunks = spark.createDataFrame(same, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, 2.0 + i]) for i in range(7)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.chunk_id, r.score) for r in cells.search(queries, cells.create(chunks, 2), 5, exact=True).collect()}
    assert got == {(r.query_id, r.chunk_id, r.score) for r in search.vector_top_k(queries, chunks, 5).collect()}
    none = cells.create(chunks.limit(0), 2)
    assert cells.search(queries, none, 5).count() == 0 == cells.search(queries.limit(0), cells.create(chunks, 2), 5).count()


def test_vector_search_holds_a_tile_of_scores_and_keeps_ties_by_id():
    import tracemalloc

    rng = np.random.default_rng(3)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.integers(-2, 3, (n, 8)) + 0.25)
    queries, x, ids = unit(700), unit(9000), rng.permutation(9000)
    best = search._Best(queries, 7, 6)
    tracemalloc.start()
    for at in range(0, 9000, 3000):
        best.add(ids[at : at + 3000], x[at : at + 3000])
    query, chunk, score = best.found()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.round(queries @ x.T, 6)
    want = [sorted(zip(-row, ids, strict=True))[:7] for row in s]
    assert chunk.reshape(700, 7).tolist() == [[int(c) for _, c in w] for w in want]
    assert np.allclose(score.reshape(700, 7), [[-v for v, _ in w] for w in want])
    assert most < 3000 * 700 * 8


def test_trigrams_are_no_rows(spark):
    """Neither an aggregate nor a sort holds the trigrams of many texts in one task."""
    rows = lambda name: spark.createDataFrame([(1, "some words"), (2, "others")], f"{name} long, text string")
    plan = grams.similar(rows("query_id"), rows("chunk_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Generate|Aggregate|Sort|Join", plan)


def test_a_block_of_postings_holds_narrow_numbers():
    block = postings._Block(["text"])
    block.add(1, ["some words and words", "some words and words"])
    assert {a.dtype for a in block.parts[0]} == {np.dtype(np.int32)}
    assert block.rows(0).num_rows
