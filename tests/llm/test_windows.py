import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import substrings, suffixes, tokens

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words_brute(docs, width):
    split = {k: SPACE.findall(t or "") for k, t in docs}
    seen = {}
    for w in split.values():
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    out = {}
    for k, w in split.items():
        hit = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                hit[i : i + width] = [True] * width
        out[k] = (len(w), sum(hit), hashlib.sha256(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode()).hexdigest())
    return out


def bytes_brute(docs, width):
    seen, out = set(), {}
    for k, t in sorted(docs):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                hit[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        out[k] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(bytes(c for c, h in zip(b, hit, strict=True) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_words_equal_brute_force(spark, prose, hot):
    docs = list(enumerate(prose))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()}
    assert got == words_brute(docs, 35) and any(n for _, n, _ in got.values())


@pytest.mark.parametrize("hot", [20_000, 2])
def test_bytes_equal_brute_force(spark, prose, hot):
    docs = [*enumerate(prose), (900, "ab" * 400), (901, "x" * 350)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()}
    assert got == bytes_brute(docs, 100)


def test_odd_rows(spark, odd):
    rows = substrings.report(odd).collect()
    assert len(rows) == odd.count() and sorted(r.n_words for r in rows)[:3] == [0, 0, 0]
    by = {r.doc_id: r for r in rows if r.doc_id in (5, 6)}
    assert by[5].n_removed == 30_000 and by[6].n_removed == 30_000 and by[6].kept == "ende"
    rows = suffixes.report(odd).collect()
    assert len(rows) == odd.count() and {r.n_removed for r in rows if r.doc_id == 1} == {0}
    assert substrings.report(odd.limit(0)).count() == suffixes.report(odd.limit(0)).count() == 0


def test_cleaned_keeps_columns(spark, odd):
    out = substrings.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert {r.text for r in out.collect() if r.doc_id == 6} == {"ende"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=60), max_size=5), st.integers(4, 12), st.integers(1, 4))
def test_super_kmers_cover_each_window_once(texts, width, k):
    import pyarrow as pa

    for _, _, data, offs in tokens.slices(pa.array(texts, pa.string())):
        rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        grams = tokens.Hasher(1).grams(data.astype(np.uint64), k)
        s, n, at = tokens.super_kmers(grams, k, rows, width)
        covered = [i for a, m in zip(s.tolist(), n.tolist(), strict=True) for i in range(a, a + m)]
        assert covered == [i for i in range(len(rows) - width + 1) if rows[i] == rows[i + width - 1]]
        assert all(a + m - 1 <= p <= a + width - k for a, m, p in zip(s.tolist(), n.tolist(), at.tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200).map(lambda b: bytes(97 + x % 2 for x in b)), st.integers(1, 20))
def test_radix_groups_are_the_repeated_strings(data, width):
    at = np.arange(max(len(data) - width + 1, 0))
    got, group = suffixes.radix_groups(np.frombuffer(data, np.uint8), at, width)
    strings = [data[i : i + width] for i in at]
    assert sorted(got.tolist()) == [i for i in at if strings.count(strings[i]) > 1]
    assert all((group[i] == group[j]) == (strings[got[i]] == strings[got[j]]) for i in range(len(got)) for j in range(i))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_words_are_the_patterns(texts):
    import pyarrow as pa

    got = []
    for _, _, data, offs in tokens.slices(pa.array(texts, pa.string()), 8):
        s, e, _ = tokens.words(data, offs, tokens.SPACES)
        got += [data[a:b].tobytes().decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    assert got == [w for t in texts for w in SPACE.findall(t)]


def _thue_morse(n):
    a = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_sums_of_powers_confuse(spark, n):
    from lectern.llm import decontaminate

    one, two = _thue_morse(n)
    shared = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join([*shared, one])), (2, " ".join([*shared, two]))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.report(docs).collect()] == [0, 0]
    bench = spark.createDataFrame([(1, " ".join([*shared[:9], one]))], "item_id long, text string")
    texts = spark.createDataFrame([(1, " ".join([*shared[:9], two])), (2, " ".join([*shared[:9], one]))], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(texts, bench).collect()} == {1: 0, 2: 10}


def test_windows_of_one_hash_are_compared_by_bytes(prose):
    """With a hash that says nothing, buckets still count exactly."""
    width = 5
    texts = [" ".join(t.split()).encode() for t in prose[:40] if len(t.split()) >= width]
    real = substrings._RUN.grams
    want = substrings._order(texts, None, None, width)
    try:
        substrings._RUN.grams = lambda items, k: real(items, k) * np.uint64(0)
        got = substrings._order(texts, None, None, width)
    finally:
        del substrings._RUN.grams
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and len(want[0])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=6))
def test_hashes_and_comparisons_go_by_the_bytes(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    h = tokens.Hasher(3).words(data, starts, ends)
    i, j = (x.ravel() for x in np.indices((len(words),) * 2))
    same = tokens.same_bytes(data, starts[i], starts[j], (ends - starts)[i], (ends - starts)[j], long=40)
    assert same.tolist() == [words[a] == words[b] for a, b in zip(i, j, strict=True)] == (h[i] == h[j]).tolist()


def test_radix_groups_are_in_order_of_suffixes():
    data = np.frombuffer(b"mississippi river mississippi mud " * 3, np.uint8)
    at, _ = suffixes.radix_groups(data, np.arange(len(data) - 19), 20)
    strings = [data[i : i + 20].tobytes() for i in at]
    assert strings == sorted(strings)
