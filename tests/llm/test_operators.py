import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, fingerprint, lm, neardup, quality, substrings, suffixes, toxicity, warc
from lectern.llm.common import fold


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- fingerprints ---


def test_fingerprints(spark, prose, odd):
    docs = dict(enumerate(prose))
    rows = {r.doc_id: r for r in fingerprint.edited_likeness(frame(spark, prose)).collect()}
    order = sorted(docs, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = docs[a], len(docs[a])
        edited = t[: n - n // 2] + docs[b][: n // 2]
        assert rows[a].n_chars == n and rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[a].fingerprint == rows[a].edited_fingerprint) == (t == edited) or sorted(t.split("\n")) == sorted(edited.split("\n"))
    likes = [r for r in rows.values() if r.n_chars > 200]
    assert sum(r.near_edited > r.near_next for r in likes) > 0.9 * len(likes)
    assert fingerprint.edited_likeness(odd).count() == odd.count() and fingerprint.edited_likeness(odd.limit(0)).count() == 0


def test_fingerprints_are_homomorphic(spark):
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame(spark, ["a b\nc d e", "c d e\na b", "a b\nc d f"])).collect()}
    assert prints[0] == prints[1] != prints[2]
    rows = fingerprint.vectors(frame(spark, ["a b\nc d e", "a b", "c d e"]), ["doc_id"]).select("doc_id", "wide", "dense").collect()
    by = {r.doc_id: [np.array(x, np.int64) for x in (r.wide, r.dense)] for r in rows}
    assert all(((y + z - x) % (1 << bits) == 0).all() for x, y, z, bits in zip(*(by[i] for i in range(3)), (32, 40), strict=True))
    both = spark.createDataFrame([(by[0][0].tolist(), by[1][0].tolist(), by[0][1].tolist(), by[1][1].tolist())], "a array<long>, b array<long>, c array<long>, d array<long>")
    left = both.select(fingerprint.add(F.col("a"), F.col("b"), -1).alias("wide"), fingerprint.add(F.col("c"), F.col("d"), -1, 40).alias("dense")).first()
    assert left.wide == (by[2][0] % (1 << 32)).tolist() and left.dense == by[2][1].tolist()


@pytest.mark.parametrize(("unit", "n"), [("\\n", 5_000_000), ("ab c ", 1_500_000)])
def test_vectors_of_huge_texts_are_the_sums_of_their_halves(spark, unit, n):
    """No lane overflows, or runs into another one, however often a paragraph or a pair stands in a text."""
    base = spark.createDataFrame([(1,), (2,)], "doc_id long")
    text = F.when(F.col("doc_id") == 1, F.expr(f"concat('x', repeat('{unit}', {n}), '\\nx', repeat('{unit}', {n}))")).otherwise(F.expr(f"concat('x', repeat('{unit}', {n}))"))
    whole, half = (r for r in fingerprint.vectors(base.select("doc_id", text.alias("text")), ["doc_id"]).orderBy("doc_id").collect())
    for c, bits in (("dense", 40), ("wide", 32)):
        assert ((2 * np.array(half[c], np.int64) - np.array(whole[c], np.int64)) % (1 << bits) == 0).all()
    assert (whole.pairs, whole.paragraphs) == (2 * half.pairs, 2 * half.paragraphs)


def test_fingerprints_of_texts_of_many_lines(spark):
    rows = fingerprint.edited_likeness(frame(spark, ["a\n" * 100_000, "b c\n" * 100_000])).collect()
    assert len({r.fingerprint for r in rows}) == 2 and all(r.near_next < 0.4 for r in rows)


def test_dense_lanes_are_hashes_of_their_own(spark):
    """No lane follows from another: paragraphs of equal first lanes (in a few bits) don't agree in the others."""
    texts = [f"paragraph {i}" for i in range(2000)]
    rows = fingerprint.vectors(frame(spark, texts), ["doc_id"]).select("dense").collect()
    made = np.array([r.dense for r in rows])
    first = made[:, 0] & 7
    for lane in range(1, fingerprint.DENSE):
        for value in range(8):
            bits = (made[first == value, lane] & 7).tolist()
            assert len(set(bits)) == 8


def brute_likeness(a, b):
    """The cosine of the multisets of word pairs of paragraphs."""
    sets = []
    for t in (a, b):
        c = Counter()
        for line in t.split("\n"):
            w = [x for x in re.split(r"[ \t\r\f]+", line) if x]
            c.update(zip(["", *w], w))
        sets.append(c)
    x, y = sets
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def test_likeness_is_the_cosine_within_its_error(spark, prose):
    rows = {r.doc_id: r for r in fingerprint.edited_likeness(frame(spark, prose)).collect()}
    order = sorted(range(len(prose)), reverse=True)
    errors = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = prose[a], len(prose[a])
        edited = t[: n - n // 2] + prose[b][: n // 2]
        errors += [rows[a].near_edited - brute_likeness(t, edited), rows[a].near_next - brute_likeness(t, prose[b])]
    assert np.std(errors) < 0.065 and max(map(abs, errors)) < 5 * 0.065


def test_ids_that_are_no_integers(spark, prose):
    named = frame(spark, prose[:30]).select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text")
    plain, said = ({int(str(r.doc_id).removeprefix("d")): r[1:] for r in fingerprint.edited_likeness(x).collect()} for x in (frame(spark, prose[:30]), named))
    assert plain == said
    for report in (substrings.report, suffixes.report):
        a, b = (sorted(tuple(r)[1:] for r in report(x).collect()) for x in (frame(spark, prose[:30]), named))
        assert a == b
    assert neardup.classes(named).filter("representative").count() == neardup.classes(frame(spark, prose[:30])).filter("representative").count()


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe_cuts_change_nothing(codec):
    one = bpe.Codec.of(*codec)
    texts = ["It's  a\n\n test — 12 ab'll " * 40, "x" * 3000 + "  " + "y" * 3000, " " * 1030 + "a" + " " * 1500, "\n" * 1100, "a" + "\t" * 1024 + "\tb 'sé 漢字"]
    for t in texts:
        assert one.encode(t, long=50) == one.encoding.encode_ordinary(t)
        assert one.decode(one.encode(t, long=7)) == t.encode()
    assert one.decode(one.encode(" " * 300_000 + "z")) == b" " * 300_000 + b"z"


def test_bpe_rows(spark, odd, codec):
    rows = bpe.encode(odd, *codec)
    assert rows.count() == odd.count() and bpe.encode(odd.limit(0), *codec).count() == 0
    back = bpe.decode(rows, *codec).select(F.sha2("decoded", 256).alias("d"), "decoded_sha256").collect()
    assert all(r.d == r.decoded_sha256 for r in back)
    assert {r.n_tokens for r in rows.collect() if r.doc_id in (2, 3)} == {0}


# --- WARC ---


def test_warc_round_trip(spark, tmp_path):
    texts = ["<p>é" + "漢" * 30_000 + "</p>", "", None, "same", "same", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i}\r\n", t, "x") for i, t in enumerate(texts)] + [(None, "u", "none", "y")], "page_id long, url string, html string, payload string")
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        import base64

        assert rows[i].payload_bytes == len(raw) and rows[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(rows[i].record_type, rows[i].refers_to) for i in (1, 2, 3, 4)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3)]
    assert rows[None].record_type == "response" and warc.round_trip(pages.limit(0)).count() == 0
    repeated = pages.filter("page_id = 3").unionByName(pages.filter("page_id = 3"))
    assert sorted(r.record_type for r in warc.round_trip(repeated).collect()) == ["response", "revisit"]


def test_segments_must_be_whole(spark):
    block = warc._HEAD + warc.chunked(b"0123456789")
    parts = [("o", 1, None, "response", "1", None, "d", 10, None, block[:60]), ("o", 2, len(block), "continuation", None, None, None, None, None, block[60:]), ("q", 1, None, "response", "2", None, "d", 10, None, block[:60]), ("q", 3, len(block), "continuation", None, None, None, None, None, block[60:])]
    rows = {r.page: r for r in warc.payloads(warc.reassembled(spark.createDataFrame([(*p[:9], bytearray(p[9])) for p in parts], warc._OUT))).collect()}
    assert bytes(rows["1"].payload) == b"0123456789" and rows["1"].complete and rows["2"].payload is None and not rows["2"].complete


def test_chunked_framing():
    for data in (b"", b"x", "é漢".encode() * 5000):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")


# --- decontamination ---


def brute_hits(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: pattern.findall((s or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {}
    for name, t in items:
        w = low(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = {}
    for k, t in docs:
        w, found = low(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if names := wins.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    found |= names
        out[k] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


@pytest.mark.parametrize("block", [500_000, 30])
def test_decontamination_equals_brute_force(spark, prose, block):
    items = [(1, prose[0][:300]), (2, prose[20]), (3, "balan"), (4, "Demer  KIDOS"), (5, None), (6, " . "), (7, prose[0][40:200])]
    docs = list(enumerate(prose))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(frame(spark, prose), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()}
    assert got == brute_hits(docs, items)


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "Plain text of some words"), (2, None)], "item_id long, text string")
    rows = decontaminate.report(odd, bench).collect()
    assert len(rows) == odd.count() and sum(r.contaminated for r in rows) == 2
    assert decontaminate.report(odd, bench.limit(0)).filter("contaminated").count() == 0 and decontaminate.report(odd.limit(0), bench).count() == 0
    out = decontaminate.cleaned(odd, bench, max_coverage=1.0)
    assert out.columns == odd.columns and {r.text for r in out.filter("doc_id = 1").collect()} == {"."}


@pytest.mark.parametrize("cover", [0.8, 1.0])
def test_cleaning_by_blocks_equals_one_block(spark, cover):
    w = [f"w{i}" for i in range(60)]
    # the second item has under ten words of its own, and no item covers 0.8 of a text alone
    items = spark.createDataFrame([(1, " ".join(w[:25])), (2, " ".join(w[15:33])), (3, " ".join(w[50:]))], "item_id long, text string")
    texts = ["x y " + " ".join(w[:33]) + " z" * 40, " ".join(w), " ".join(w[:33]) + " rest of it", "none", None]
    one, many = ({r.doc_id: r.text for r in decontaminate.cleaned(frame(spark, texts), items, max_coverage=cover, block_words=n).collect()} for n in (500_000, 20))
    assert one == many and one[0].split() == ["x", "y", *["z"] * 40] and one[2].strip() == ("" if cover == 0.8 else "rest of it")


# --- near duplicates ---


def test_near_duplicates_equal_brute_force(spark, prose):
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, prose)).collect()}
    split = {k: t.split() for k, t in enumerate(prose)}
    shingles = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, w in split.items()}

    def linked(least):
        root = {k: k for k in split}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in split:
            for b in range(a):
                if prose[a] == prose[b] or sum((shingles[a] & shingles[b]).values()) >= least * sum((shingles[a] | shingles[b]).values()):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        return {k: find(k) for k in split}

    # weights move similarities a little: what is clearly alike is together, and nothing else is
    sure, loose = linked(0.83), linked(0.77)
    assert all(got[k] == got[sure[k]] for k in split)
    assert all(loose[k] == loose[got[k]] for k in split)
    assert len(set(got.values())) < len(split)


def test_near_duplicates_by_their_own_weights(spark, prose):
    """Recall of the pairs at the threshold, by weighted Jaccard similarity: classes equal those of all pairs, on many edited copies."""
    import random

    rng = random.Random(12)
    texts = list(prose)
    for i in range(150):
        w = prose[i % 40].split() * 2
        for _ in range(rng.randrange(len(w) // 8 + 1)):
            w[rng.randrange(len(w))] = f"e{i}x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    want = brute_classes(spark, texts)
    together = [(a, b) for a in want for b in range(a) if want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in together) >= 0.99 * len(together) and all(want[a] == want[b] for a in got for b in range(a) if got[a] == got[b])


def test_a_large_group_and_odd_rows(spark, odd):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(150):
        w = list(base)
        w[rng.randrange(150)] = f"n{i}"
        texts.append(" ".join(w))
    rows = neardup.classes(frame(spark, texts)).collect()
    assert {r.class_id for r in rows} == {0} and sum(r.representative for r in rows) == 1
    rows = neardup.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[5] == by[6] == {5} and by[2] == by[3] == {2} and len(by[7]) == 1
    assert neardup.classes(odd.limit(0)).count() == 0
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id = 6").count() == 0


def brute_classes(spark, texts, threshold=neardup.THRESHOLD):
    """The classes of all pairs of at least the threshold, by the operator's own weights."""
    import pyarrow as pa

    idf, _ = neardup.document_frequencies(frame(spark, texts).withColumnRenamed("doc_id", "key"))
    sets = []
    for _, n, grams, weights, counts in neardup.shingled(pa.array(texts), idf):
        edge = np.concatenate([[0], np.cumsum(counts)])
        sets += [(grams[edge[i] : edge[i + 1]], weights[edge[i] : edge[i + 1]]) for i in range(n)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and neardup.weighted_jaccard(sets[a], sets[b]) >= threshold:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return dict(enumerate(root))


@pytest.fixture
def one_bucket(monkeypatch):
    """All texts share one band and no other."""
    real = neardup.sketched
    monkeypatch.setattr(neardup, "sketched", lambda base, idf: real(base, idf).withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.lit(1).cast("long")))))


def test_pairs_on_one_template_are_found(spark, one_bucket):
    """Pairs alike at about 0.9, each at about 0.7 to a template that all 120 texts share."""
    import random

    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        at = rng.randrange(150)
        w[at : at + 25] = [f"a{i}x{j}" for j in range(25)]
        texts.append(" ".join(w))
        w[at + 10] = f"b{i}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(spark, texts) and 40 < len(set(got.values())) < 70


def test_chains_of_edited_copies_are_found(spark, one_bucket):
    """Copies of copies on one template, neighbours alike at about 0.86 and texts further apart below the threshold."""
    import random

    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for c in range(4):
        w = list(base)
        for i in range(12):
            for at in (15 * i + 1, 15 * i + 6, 15 * i + 11):
                w[at] = f"c{c}x{i}x{at}"
            texts.append(" ".join(w))
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, texts)).collect()}
    assert got == brute_classes(spark, texts)


def test_sampling_agrees_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    grams = np.sort(rng.integers(1, 1 << 63, 400).astype(np.uint64))
    a, b = (grams[:350], rng.random(350).astype(np.float32) + 0.5), (grams[30:], rng.random(370).astype(np.float32) + 0.5)
    made = [neardup.sketches(g, w, np.array([len(g)]))[0] for g, w in (a, b)]
    assert abs((made[0] == made[1]).mean() - neardup.weighted_jaccard(a, b)) < 4 * math.sqrt(0.25 / 48)


# --- classifiers ---


def labelled(spark):
    import random

    rng = random.Random(2)
    words = [a + b for a in "ba de ki lo mu ne po ra su ti".split() for b in "lan mer dos tik fen gar".split()]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grumpfel", "grumpfix", "zornbold"]))
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        rows.append((i, text))
        labels.append((i, 1 - bad, int(toxic)))
    rows += [(500, None), (501, ""), (None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, cut):
    held = fold("doc_id", 5) == 0
    rows = scored.filter(held).join(labels, "doc_id").filter(F.col(column).isNotNull()).collect()
    return sum((r.score >= cut) == (r[column] == 1) for r in rows) / len(rows)


def test_quality(spark, odd):
    docs, labels = labelled(spark)
    allowed = fold("doc_id", 5) != 0
    scored = quality.score(docs, labels, allowed)
    assert scored.count() == docs.count() and accuracy(scored, labels, "quality", 0.3) > 0.97
    clash = docs.withColumns({c: F.lit("clash") for c in ("_f0", "_text", "_rest", "_y", "_l", "quality")})
    kept = quality.accepted(clash, labels, allowed)
    assert kept.columns == clash.columns and 0 < kept.count() < docs.count() and kept.filter("_f0 = 'clash'").count() == kept.count()
    none = quality.score(odd, labels.limit(0), allowed)
    assert none.count() == odd.count() and {r.score for r in none.collect()} == {0.5}
    assert quality.score(odd.limit(0), labels, allowed).count() == 0


def test_rules_as_columns_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.random((500, len(quality.FEATURES)))
    rules = quality.fit(x, ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], [f"_f{i}" for i in range(x.shape[1])])
    assert np.allclose([r.s for r in frame.select(rules.column().alias("s")).collect()], rules.predict(x[:50]))


def test_toxicity(spark, odd):
    docs, labels = labelled(spark)
    allowed = fold("doc_id", 5) != 0
    scored = toxicity.score(docs, labels, allowed)
    assert scored.count() == docs.count() and accuracy(scored, labels, "toxic", 0.5) > 0.9
    none = toxicity.score(odd, labels.limit(0), allowed)
    assert none.count() == odd.count() and all(r.score == 0.5 for r in none.collect())
    assert toxicity.score(odd.limit(0), labels, allowed).count() == 0


def brute_maxima(model, ids):
    """The filters' maxima of one text, word by word."""
    out = []
    x = [sum(model.table[i].astype(float) for i in row) for row in ids]
    for width, w in model.filters.items():
        acts = [np.concatenate(x[k : k + width]) @ w for k in range(len(x) - width + 1)]
        out.append(np.maximum(np.max(acts, axis=0) + model.biases[width], 0) if acts else np.zeros(w.shape[1]))
    return np.concatenate(out)


def small_model(rng):
    filters = {w: rng.normal(0, 0.5, (w * toxicity.SIZE, n)).astype(np.float32) for w, n in toxicity.FILTERS.items()}
    table = rng.normal(0, 0.5, (50, toxicity.SIZE)).astype(np.float32)
    return toxicity.Model(table, filters, {w: rng.normal(0, 0.1, n).astype(np.float32) for w, n in toxicity.FILTERS.items()}, rng.normal(0, 1, sum(toxicity.FILTERS.values())).astype(np.float32), 0.1, np.zeros(5))


def test_convolution_and_pooling_equal_brute_force():
    rng = np.random.default_rng(3)
    model = small_model(rng)
    counts = np.array([0, 1, 2, 7, 3, 0, 40])
    ids = rng.integers(0, 50, (counts.sum(), 1 + len(toxicity.PREFIXES)))
    got = model.maxima(ids, counts)[0]
    cut = np.concatenate([[0], np.cumsum(counts)])
    for i in range(len(counts)):
        assert np.allclose(got[i], brute_maxima(model, ids[cut[i] : cut[i + 1]]), atol=1e-4)
    logits = model.logits(ids, counts)
    assert np.allclose(logits, got @ model.weights + model.bias) and np.allclose(model.scores(ids, counts, np.zeros(len(counts), int)), 1 / (1 + np.exp(-logits)))


def test_gradients_of_the_convolution_are_right():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    counts = np.array([6, 1, 9, 4])
    ids = rng.integers(0, 50, (counts.sum(), 1 + len(toxicity.PREFIXES)))
    y, weight = np.array([1.0, 0, 0, 1]), np.array([2.0, 1, 1, 2])

    def loss():
        z = model.logits(ids, counts)
        return float((weight * (np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))).sum() / len(y))

    grads, (at, change) = toxicity.gradients(model, ids, counts, y, weight)
    table = np.zeros_like(model.table)
    for i in range(ids.shape[1]):
        np.add.at(table, ids[at, i], change)
    pairs = [(model.weights, grads["weights"]), (model.table, table), *((model.filters[w], grads[w]) for w in model.filters), *((model.biases[w], grads["bias", w]) for w in model.filters)]
    for value, grad in pairs:
        for spot in zip(*np.unravel_index(np.argsort(-np.abs(grad), axis=None)[[0, 3, 6]] if grad.size > 6 else [0], value.shape), strict=True):
            before = value[spot]
            value[spot] = before + 2e-3
            up = loss()
            value[spot] = before - 2e-3
            down = loss()
            value[spot] = before
            assert math.isclose((up - down) / 4e-3, grad[spot], rel_tol=0.08, abs_tol=0.01)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(len(words), 1), max(len(text), 1)
    ascii_symbols = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - set(",.")
    upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "\u00c0" <= c <= "\u00de" for c in text)
    letters = max(1, sum(c.isascii() and c.isalpha() or not c.isascii() for c in text))
    top = Counter(words).most_common(1)
    return [
        math.log1p(len(words)), sum(len(w.encode()) for w in words) / n, upper / letters, sum(c in "0123456789" for c in text) / chars, sum(c in ascii_symbols for c in text) / chars, text.count("|") / chars, text.count("!") / chars,
        sum(c in " \t\n\x0b\x0c\r" for c in text) / chars, sum(not c.isascii() for c in text) / chars, len(words) / (text.count("\n") + 1), len(set(words)) / n if words else 0, top[0][1] / n if top else 0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(w[-1] in ascii_symbols for w in words) / n, sum(w[-1] in ".?!" for w in words) / n, math.log1p(max((len(w.encode()) for w in words), default=0)),
    ]


def test_statistics_equal_brute_force(prose):
    import pyarrow as pa

    texts = [*prose[:30], "", " \n ", "ÄPFEL und Öl! Öl! 12|3 (x) é", "漢字 A.B. c?! c?!", "x" * 300, None]
    got = quality.statistics_of(pa.array(texts, pa.string()))
    assert np.allclose(got, [brute_statistics(t or "") for t in texts], atol=1e-9)


# --- language model ---


def test_language_model_counts_equal_brute_force(spark, prose, odd):
    docs = dict(enumerate(prose))
    got = {r.doc_id: r for r in lm.score(frame(spark, prose), fold("doc_id", 7) != 2).collect()}
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t) + [None] for k, t in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in split[k])
    n, v = sum(c.values()), len(c)
    for k, w in split.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[k].base_score, base, rel_tol=1e-9) and got[k].score < 0
    rows = lm.score(odd, fold("doc_id", 7) != 2).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm.score(odd.limit(0), fold("doc_id", 7) != 2).count() == 0
    assert lm.score(odd.filter("doc_id < 3"), F.lit(False)).filter("n_known > 0").count() == 0


def test_a_document_over_the_sample_bound_is_passed_over(spark):
    texts = ["a b c d e f g h " * 20] * 3 + ["long " * 3000]
    docs = frame(spark, texts).select(F.col("doc_id").alias("row"), F.lit(True).alias("train"), "text")
    start = lm.Network.start(np.zeros(lm.IDS) + np.eye(lm.IDS)[lm._END_ID] * 4)
    assert lm._fitting(np.array([9.0, 3, 9, 3, 3]), 7).tolist() == [False, True, False, True, False]
    for first in range(4):  # whichever comes first in order of hash
        moved = docs.withColumn("row", F.col("row") + first * 10)
        got = lm.train(moved, [], np.zeros((lm.GROUPS, 2), np.int64), 4, max_tokens=200)
        assert not np.allclose(got.turn, start.turn)


def test_all_training_documents_shape_the_network(spark, monkeypatch):
    """What only documents outside the sample hold is learnt: after 'ping' comes 'pong', over several shards."""
    monkeypatch.setattr(lm, "SHARD", 200_000)
    texts = ["ping pong " * 1000 if i % 2 else "pong pong ping ping " * 20 for i in range(400)]
    docs = frame(spark, texts).select(F.col("doc_id").alias("row"), (F.col("doc_id") % 2 == 1).alias("train"), "text")
    h = [next(lm.tokenised(__import__("pyarrow").array([w])))[1][0] for w in ("ping", "pong")]
    best = [{"h": int(x.astype(np.int64)), "n": 200_000} for x in h]
    args = docs, best, np.zeros((lm.GROUPS, 2), np.int64), 200
    small = lm.train(*args, max_rows=1)
    ids = np.array([0, 1] * 20)
    fair = 40 * math.log(0.5)
    assert small.likelihoods(ids, np.array([40]))[0] > 0.8 * fair
    again = lm.train(docs.repartition(7), *args[1:], max_rows=1)
    assert np.allclose(small.weights(), again.weights(), atol=1e-4)


def test_probabilities_add_up_and_state_is_carried():
    net = lm.Network.start(np.arange(lm.IDS, dtype=float))
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.log_p(h, np.array([i]))[0]) for i in range(lm.IDS))
    assert abs(total - 1) < 1e-4
    ids = np.random.default_rng(1).integers(0, lm.IDS, 900)
    sizes = np.array([500, 1, 399])
    together = net.likelihoods(ids, sizes, window=2)
    for i, (a, b) in enumerate(((0, 500), (500, 501), (501, 900))):
        state, alone = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for t in range(a, b):
            if t > a:
                state = net.step(ids[t - 1 : t], state)
            alone += net.log_p(state, ids[t : t + 1])[0]
        assert math.isclose(alone, together[i], rel_tol=1e-4)


def test_gradients_are_right():
    net = lm.Network.start(np.ones(lm.IDS))
    h = np.random.default_rng(2).normal(size=(6, lm.HIDDEN)).astype(np.float32)
    ids = np.array([0, 5, 9, 5, lm.IDS - 1, 77])
    grads = {k: np.zeros_like(getattr(net, k)) for k in ("to_class", "class_bias", "to_word", "word_bias")}
    net.log_p(h, ids, grads)
    for name, at in (("to_class", (3, 1)), ("to_word", (5, 2)), ("word_bias", (9,))):
        value = getattr(net, name)
        value[at] += 1e-2
        up = -net.log_p(h, ids).sum()
        value[at] -= 2e-2
        down = -net.log_p(h, ids).sum()
        value[at] += 1e-2
        assert math.isclose((up - down) / 2e-2, grads[name][at], rel_tol=0.05, abs_tol=0.02)


def test_gradients_through_time_are_right():
    """Numerical gradients of what enters the state and turns it, over a window with a text's end and a state from before."""
    rng = np.random.default_rng(6)
    net = lm.Network.start(np.ones(lm.IDS))
    net.turn += rng.normal(0, 0.3, net.turn.shape).astype(np.float32)
    part = rng.integers(0, 20, (7, 5))
    part[3, 2] = lm._END_ID
    before = np.vstack([rng.integers(0, 20, (1, 5)), part[:-1]])
    h = rng.normal(0, 0.5, (5, lm.HIDDEN)).astype(np.float32)

    def loss():
        state, total = h, 0.0
        for i in range(len(part)):
            state = net.step(before[i], state) * (before[i] != lm._END_ID)[:, None]
            total -= net.log_p(state, part[i]).sum()
        return total

    grads, last = net.gradients(before, part, h)
    assert grads.keys() == set(lm.WEIGHTS) and last.shape == h.shape
    for name in ("enter", "turn", "to_class", "to_word"):
        value = getattr(net, name)
        for at in zip(*np.unravel_index(np.argsort(-np.abs(grads[name]), axis=None)[[0, 5, 20, 60]], value.shape), strict=True):
            value[at] += 1e-2
            up = loss()
            value[at] -= 2e-2
            down = loss()
            value[at] += 1e-2
            assert math.isclose((up - down) / 2e-2, grads[name][at], rel_tol=0.05, abs_tol=0.02)


def test_a_long_labelled_text_is_passed_over(spark):
    """The sample goes on behind a text that doesn't fit, wherever it lies in the order of hashes."""
    texts = [f"vile nasty words {i}" if i % 3 == 0 else f"kind gentle words {i}" for i in range(60)]
    first = min(range(60), key=lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0])
    texts[first] = "words " * 5000
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    model = toxicity.train(docs, labels, "toxic", F.lit(True), max_words=2000)
    whole = toxicity.train(docs.filter(F.col("doc_id") != first), labels, "toxic", F.lit(True), max_words=2000)
    assert np.abs(model.weights).sum() > 0 and np.allclose(model.weights, whole.weights)


def test_what_the_driver_takes_of_frequencies_and_samples_are_columns(spark, monkeypatch):
    """Rows of Python objects would take it a hundred MB."""
    from pyspark.sql import DataFrame

    from lectern.llm import neardup, quality

    def refused(self):
        raise AssertionError("rows in the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    docs = spark.createDataFrame([(i, f"w{i} common words") for i in range(30)] + [(30, None)], "doc_id long, text string")
    idf, n = neardup.document_frequencies(docs)
    assert n == 31 and (idf < idf.max()).sum() == 32
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    assert isinstance(quality.train(quality.statistics(docs), labels, "quality", F.col("doc_id") >= 0), quality.Rules)
