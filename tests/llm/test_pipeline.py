import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    import corpus_pipeline
    from lectern.llm.common import stored, table

    made = [table(spark, str(DATA), "documents")]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], str(DATA)), name))
    return made


def test_stages_keep_columns_and_only_remove(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == stages[0].columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
    assert stages[-1].count() == stages[-2].count() and {"doc_id", "n_tokens", "ids"} <= set(stages[-1].columns)


def held(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage_equals_brute_force_on_its_input(spark, stages):
    import public_tokenizers
    from test_operators import brute_classes
    from test_windows import SPACE

    from lectern.llm import bpe, quality
    from lectern.llm.common import fold, table

    start, accepted, single, cut, clean = (held(x) for x in stages[:5])
    scores = {r.doc_id: r.score for r in quality.score(stages[0], table(spark, str(DATA), "labels"), fold("doc_id", 5) != 0).collect()}
    assert accepted == {k: t for k, t in start.items() if scores[k] >= 0.3}

    ids = sorted(accepted)
    classes = brute_classes(spark, [accepted[k] or "" for k in ids])
    empty = [i for i, k in enumerate(ids) if not SPACE.findall(accepted[k] or "")]
    assert single == {ids[i]: accepted[ids[i]] for i in range(len(ids)) if classes[i] == i and (i not in empty or i == min(empty))}

    words = {k: SPACE.findall(t or "") for k, t in single.items()}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for k, w in words.items():
        hit = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                hit[i : i + 35] = [True] * 35
        want[k] = " ".join(x for x, h in zip(w, hit, strict=True) if not h) if any(hit) else single[k]
    assert cut == want

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    windows = set()
    for r in table(spark, str(DATA), "benchmark").collect():
        w = pattern.findall(low(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    want = {}
    for k, t in cut.items():
        found = list(pattern.finditer(low(t)))
        w = [m[0] for m in found]
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        out, end = "", 0
        for i, m in enumerate(found):
            if hit[i]:
                if i == 0 or not hit[i - 1]:
                    out += t[end : m.start()]
                end = m.end()
        want[k] = t if not any(hit) else "" if sum(hit) / len(hit) > 0.8 else out + t[end:]
    assert clean == want

    codec = bpe.Codec.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in stages[5].collect()} == {k: codec.encoding.encode_ordinary(t or "") for k, t in clean.items()}
    assert all(r.n_chars == len(r.text or "") for r in stages[4].collect())


def test_stages_take_odd_rows_and_empty_tables(spark, odd):
    import corpus_pipeline

    if not DATA.exists():
        pytest.skip("no test tables here")
    whole = odd.withColumns({c: F.lit("clash") for c in ("_rest", "_text", "_f0", "_y", "_spans", "n_chars_")})
    for docs in (whole, whole.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(DATA))
            assert out.columns == docs.columns, name
            ids = {r.doc_id for r in out.collect()}
            assert ids <= {r.doc_id for r in docs.collect()}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
