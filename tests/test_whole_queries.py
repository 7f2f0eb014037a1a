import re

import pytest

from lectern.functions.english import stem
from lectern.operators import fusion, keywords, postings, providers
from lectern.plans import catalog

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven eight nine")]
DOCS = [(1, "alpha beta gamma delta epsilon zeta and no more"), (2, "x alpha beta gamma delta y epsilon zeta eta theta alpha"), (3, "one two three four five six seven"), (4, "nine eight seven six five four three two one"), (5, ITEMS[0][1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.findall("[a-z]+", text) for i in range(len(w) + 1)}


def cover_scores(terms, want, weight):
    """All covers of ``want`` in a list of terms, looked for from every place."""
    places, total, start = [i for i, x in enumerate(terms) if x in want], 0.0, 0
    while True:
        end = next((e for e in places if want <= {x for x in terms[start : e + 1]}), None)
        if end is None:
            return total
        begin = next(b for b in reversed(places) if start <= b <= end and want <= {x for x in terms[b : end + 1]})
        held = sum(begin <= p <= end for p in places)
        total, start = total + weight / (1 + end - begin + 1 - held), begin + 1


def brute_keywords(items=ITEMS):
    """Items and documents are lower-case words; a document is searched by stem at 0.2, then by word at 0.1."""
    out = {}
    for q, query in items:
        plain = query.split()
        scored = []
        for d, text in DOCS:
            w, at = text.split(), {}
            for i, x in enumerate(w, 1):
                if x not in postings.STOPS:
                    at.setdefault(stem(x), []).append(4 * i + 1)
            offset = max(i for i, x in enumerate(w, 1) if x not in postings.STOPS)
            for i, x in enumerate(w, 1):
                at.setdefault(x, []).append(4 * (offset + i))
            a, b = (postings.density(at, [postings.Wanted([((0, t),) for t in dict.fromkeys(want)])]) for want in ([stem(x) for x in plain if x not in postings.STOPS], plain))
            like = len(grams(query) & grams(text)) / len(grams(query) | grams(text))
            score = max(a / (a + 1), 0.75 * b / (b + 1), 0.25 * round(like, 6) if like >= 0.3 else 0.0)
            if score:
                scored.append((-round(score, 6), d))
        out[q] = [d for _, d in sorted(scored)]
    return out


def test_density_is_the_sum_over_covers():
    import random

    rng = random.Random(1)
    for _ in range(300):
        terms = [rng.choice("abcde") for _ in range(rng.randrange(1, 25))]
        at = {}
        for i, x in enumerate(terms, 1):
            at.setdefault(x, []).append(4 * i + 2)
        want = set(rng.sample("abc", rng.randrange(1, 4)))
        assert postings.density(at, [postings.Wanted([((0, t),) for t in want])]) == pytest.approx(cover_scores(terms, want, 0.4))


def window_holds(terms, w):
    has = lambda p: any(all(i + d < len(terms) and terms[i + d] == t for d, t in p) for i in range(len(terms)))
    return all(map(has, w.phrases)) and not any(map(has, w.banned))


def test_density_with_alternatives_phrases_and_bans():
    import random

    rng = random.Random(2)
    for _ in range(300):
        terms = [rng.choice("abcdxx") for _ in range(rng.randrange(1, 20))]
        phrase = lambda: tuple((i, rng.choice("abc")) for i in range(rng.choice([1, 1, 2])))
        wanted = [postings.Wanted([phrase() for _ in range(rng.randrange(1, 3))], [((0, "d"),)] * rng.randrange(2)) for _ in range(rng.randrange(1, 3))]
        used = {t for w in wanted for p in (*w.phrases, *w.banned) for _, t in p}
        at = {}
        for i, x in enumerate(terms, 1):
            at.setdefault(x, []).append(4 * i + 1)
        places, total, start = [i for i, x in enumerate(terms) if x in used], 0.0, 0
        while (end := next((e for e in places if e >= start and any(window_holds(terms[start : e + 1], w) for w in wanted)), None)) is not None:
            begin = next(b for b in reversed(places) if start <= b <= end and any(window_holds(terms[b : end + 1], w) for w in wanted))
            total += 0.2 / (1 + end - begin + 1 - sum(begin <= p <= end for p in places))
            start = begin + 1
        assert postings.density(at, wanted) == pytest.approx(total)


def test_web_syntax_and_weights(spark):
    docs = [(1, "rolling back a deployment", "Guide"), (2, "back rolling the deployment", "Guide"), (3, "pods and volumes", "Deployment"), (4, "deployments of pods", "Other")]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string, title string")
    asked = [(1, '"rolling back"'), (2, "deployment -pods"), (3, "volumes or rolling"), (4, "deployment"), (5, "zzz"), (6, None), (7, "the of")]
    rows = keywords.keyword_top_k(spark.createDataFrame(asked, "query_id long, text string"), chunks, 10).collect()
    got = {}
    for r in rows:
        # what is above the trigram arm's share of its similarity matches by words
        like = len(grams(dict(asked)[r.query_id].lower()) & grams(docs[r.chunk_id - 1][1])) / len(grams(dict(asked)[r.query_id].lower()) | grams(docs[r.chunk_id - 1][1]))
        got.setdefault((r.query_id, r.score > 0.25 * like + 1e-6), set()).add(r.chunk_id)
    assert got[1, True] == {1} and got[2, True] <= {1, 2} and got[3, True] == {1, 2, 3} and 3 in got[4, True]
    assert next(r.chunk_id for r in rows if r.query_id == 4 and r.rank == 1) == 3 and not {5, 6, 7} & {q for q, _ in got}
    index = postings.create(chunks)
    dense = {(r.query_id, r.chunk_id) for r in keywords.density_top_k(spark.createDataFrame(asked, "query_id long, text string"), index, 10).collect()}
    # the plain arm knows neither quotes nor minus signs; "pods" is no word of the first two
    assert {d for q, d in dense if q == 1} == {1, 2} and {d for q, d in dense if q == 2} == {1, 2} | ({3, 4} & {d for q, d in dense if q == 2})


def test_keyword_queries_are_whole_texts(spark, folder):
    got = {}
    for r in catalog.QUERIES["keyword_top_k"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {q: d for q, d in brute_keywords().items() if d} and got[1][0] == 5


def test_hybrid_queries_are_whole_texts(spark, folder):
    rows = catalog.QUERIES["hybrid_search"](spark, folder).collect()
    ranked = brute_keywords()
    for q, query in ITEMS:
        v = providers.hash_vector(query, 64)
        vectors = [d for _, d in sorted((-round(float(v @ providers.hash_vector(t, 64)), 6), d) for d, t in DOCS)]
        score = {d: sum(1 / (60 + some.index(d) + 1) for some in (ranked[q], vectors) if d in some) for _, d in [(0, d) for d, _ in DOCS]}
        got = [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.fused_rank)]
        assert got == sorted(score, key=lambda d: (-score[d], d))


def test_a_channel_of_the_query_fails(spark, folder, monkeypatch):
    """Hybrid search goes on by keywords alone where the embedding provider fails."""

    def broken(text, dimension):
        raise RuntimeError("no provider")

    monkeypatch.setattr(providers, "hash_vector", broken)
    rows = catalog.QUERIES["hybrid_search"](spark, folder).collect()
    ranked = brute_keywords()
    assert {q: [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.fused_rank)] for q, _ in ITEMS} == ranked
    with pytest.raises(RuntimeError):
        fusion.hybrid(lambda: 1 / 0, lambda: 1 / 0)
