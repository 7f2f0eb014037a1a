"""Retrieval, answer, citation and answerability metrics, run summaries and calibration."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions import text as T
from lectern.operators.ranges import running_sums

CUTS = (1, 3, 5, 10, 20)


def ratio(a: Column, b: Column, none: float = 0.0) -> Column:
    """a / b, or ``none`` for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def retrieval(retrieved: DataFrame, relevant: DataFrame, cases: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """recall_k, coverage_k and reciprocal_rank of each case.

    ``retrieved`` has (case_id, chunk_id, rank), ``relevant`` (case_id, chunk_id), ``cases`` (case_id). A case without relevant
    chunks has zeros.
    """
    rel = relevant.select("case_id", "chunk_id").distinct()
    sizes = rel.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = retrieved.groupBy("case_id", "chunk_id").agg(F.min("rank").alias("rank")).join(rel, ["case_id", "chunk_id"])
    found = hits.groupBy("case_id").agg(F.min("rank").alias("_first"), *[F.sum((F.col("rank") <= k).cast("long")).alias(f"_h{k}") for k in cuts])
    out = cases.select("case_id").join(sizes, "case_id", "left").join(found, "case_id", "left")
    columns = [F.coalesce((F.col("_first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}") for k in cuts]
    columns += [F.round(F.coalesce(F.col(f"_h{k}") / F.col("_n"), F.lit(0.0)), 9).alias(f"coverage_{k}") for k in cuts]
    return out.select("case_id", *columns, F.round(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)), 9).alias("reciprocal_rank"))


def mean_metrics(rows: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """Means over rows whose value isn't null; with ``by``, by group, beside the count."""
    means = [F.round(F.avg(m), 9).alias(m) for m in metrics]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *means) if by else rows.agg(F.count(F.lit(1)).alias("n"), *means)


_TOKEN = re.compile(r"\w+(?:[./:+-]\w+)*")
_NUMBER = re.compile(r"(?<!\w)v?\d+(?:\.\d+)*(?:[-+][a-z0-9.]+)?")
ANSWER = ("exact_match", "token_f1", "keyword_coverage", "numeric_consistency")


def answer_values(generated: str, reference: str, keywords: list[str] | None = None) -> tuple[float, float, float, float]:
    """ANSWER of two texts in NFKC without case; without keywords, the reference's tokens are required."""
    g, r = (unicodedata.normalize("NFKC", x).casefold() for x in (generated, reference))
    gt, rt = _TOKEN.findall(g), _TOKEN.findall(r)
    shared = sum((Counter(gt) & Counter(rt)).values())
    need = {unicodedata.normalize("NFKC", k).casefold() for k in keywords} if keywords is not None else set(rt)
    a, b = set(_NUMBER.findall(g)), set(_NUMBER.findall(r))
    f1 = 2 * shared / (len(gt) + len(rt)) if gt or rt else 1.0
    numbers = 2 * len(a & b) / (len(a) + len(b)) if b else float(not a)
    return float(gt == rt), round(f1, 9), round(sum(k in g for k in need) / len(need), 9) if need else 1.0, round(numbers, 9)


def answer_metrics(rows: DataFrame, generated: str, reference: str, keywords: str | None = None) -> DataFrame:
    """Adds ANSWER to rows with two texts, null ones being empty; one pass in Arrow batches, as normal forms are Python's."""
    picked = [generated, reference, *([keywords] if keywords else [])]
    at = [rows.columns.index(c) for c in picked]
    schema = StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in ANSWER]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(i).to_pylist() for i in at]
            made = [answer_values(g or "", r or "", *k) for g, r, *k in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], pa.float64()) for i in range(len(ANSWER)))], schema.names)

    return rows.mapInArrow(run, schema)


def confusion(rows: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """The confusion matrix of two booleans, with accuracy, precision, recall, F1 and both error rates."""
    e, p = F.col(expected), F.col(predicted)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return _rates(rows.agg(n(e & p).alias("tp"), n(~e & p).alias("fp"), n(~e & ~p).alias("tn"), n(e & ~p).alias("fn")))


def _rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    columns = {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp)}
    return counts.withColumns({k: F.round(v, 9) for k, v in columns.items()})


def calibrated(rows: DataFrame, score: str = "score", answerable: str = "answerable", margin: float = 1e-9) -> DataFrame:
    """The threshold of best (F1, accuracy, low threshold), out of all scores and one beyond either end.

    Counts at each distinct score are summed first; running sums over distinct scores, by range, then give every
    threshold's matrix, so samples and thresholds are never crossed and no task holds all scores.
    """
    at = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(answerable).cast("long")).alias("pos"), F.sum((~F.col(answerable)).cast("long")).alias("neg"))
    ends = at.agg(F.min("threshold").alias("low"), F.max("threshold").alias("high")).select(F.explode(F.array(F.col("low") - margin, F.col("high") + margin)).alias("threshold"))
    every = at.unionByName(ends.filter("threshold is not null").withColumns({"pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long")}))
    every = every.withColumn("_all", F.lit(0))
    total = every.groupBy(F.col("_all").alias("_one")).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    run = running_sums(every, ["_all"], "threshold", {"tp": "pos", "fp": "neg"}, descending=True).join(total, F.col("_all") == F.col("_one"))
    rates = _rates(run.select("threshold", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn")))
    best = rates.agg(F.max_by(F.struct("threshold", "f1", "accuracy", "tp", "fp", "tn", "fn"), F.struct("f1", "accuracy", (-F.col("threshold")).alias("low"))).alias("b"))
    return best.select("b.*")


def citations(cited: DataFrame, claims: DataFrame, cases: DataFrame) -> DataFrame:
    """precision, recall, correctness and completeness of each case's citations.

    ``cited`` has (case_id, valid, score), ``claims`` (case_id, required, supported). No citations: precision 0; no required
    claims: recall 1; no scores: correctness is precision.
    """
    c = cited.groupBy("case_id").agg(F.avg(F.col("valid").cast("double")).alias("_p"), F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("_s"))
    r = claims.filter("required").groupBy("case_id").agg(F.avg(F.col("supported").cast("double")).alias("_r"))
    out = cases.select("case_id").join(c, "case_id", "left").join(r, "case_id", "left")
    precision, recall = F.coalesce("_p", F.lit(0.0)), F.coalesce("_r", F.lit(1.0))
    return out.select("case_id", F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(F.coalesce("_s", precision), 9).alias("correctness"), F.round(recall, 9).alias("completeness"))


def expected_citation_recall(expected: Column, cited: Column) -> Column:
    """Share of expected ids that are cited; nothing expected: 1 only if nothing is cited."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) == 0, (F.size(cited) == 0).cast("double")).otherwise(ratio(F.size(F.array_intersect(e, cited)), F.size(e)))


def rewrite_deltas(raw: DataFrame, rewritten: DataFrame, k: int = 5) -> DataFrame:
    """Both runs' recall by case where neither failed; whether the rewrite helped, hurt or was needless."""
    a = raw.filter("error is null").select("case_id", F.col(f"recall_{k}").alias("raw_recall"))
    b = rewritten.filter("error is null").select("case_id", F.col(f"recall_{k}").alias("rewritten_recall"))
    both = a.join(b, "case_id")
    return both.withColumns({"delta": F.col("rewritten_recall") - F.col("raw_recall"), "needless": F.col("rewritten_recall") == F.col("raw_recall"), "harmful": F.col("rewritten_recall") < F.col("raw_recall")})


def answer_correct(factual: Column, grounded: Column) -> Column:
    """Both marks at least 4; null without marks."""
    return F.when(factual.isNotNull() & grounded.isNotNull(), (factual >= 4) & (grounded >= 4))


def worst(rows: DataFrame, n: int = 10) -> DataFrame:
    """The report's list of the worst answers by token F1."""
    return rows.orderBy("token_f1", "case_id").limit(n)


def run_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: cases, failures, metric means of good rows, tokens, and a cost that is null unless all rows succeeded and are priced."""
    good = F.col("error").isNull()
    complete = F.sum((good & F.col("cost").isNotNull()).cast("long")) == F.count(F.lit(1))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.sum((~good).cast("long")).alias("failed"),
        *[F.round(F.avg(F.when(good, F.col(m))), 9).alias(m) for m in metrics],
        F.coalesce(F.sum(F.when(good, F.col("tokens"))), F.lit(0).cast("long")).alias("tokens"), F.when(complete, F.sum("cost")).cast("double").alias("cost"), complete.alias("complete"),
    )


def balanced(cases: DataFrame, n: int, seed: int = 20250717) -> DataFrame:
    """Keep-first questions, one of each category first, then by hash up to ``n``: a seeded, bounded sample."""
    first = Window.partitionBy("_q").orderBy("case_id")
    kept = cases.withColumn("_q", T.question_key("question")).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_q")
    mark = F.xxhash64(F.lit(seed), "case_id")
    own = Window.partitionBy("category").orderBy(mark, "case_id")
    return kept.withColumn("_own", F.row_number().over(own) > 1).orderBy("_own", mark, "case_id").limit(n).drop("_own")


def built_cases(chunks: DataFrame) -> DataFrame:
    """Candidate cases of (chunk_id, title, section, content): factual and how-to templates, a hard negative, and pairs of neighbours."""
    reference = T.first_sentences("content")
    section = F.coalesce("section", F.lit("its main part"))
    say = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
    one = lambda question, category, difficulty, answerable: F.struct(question.alias("question"), F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"), F.lit(answerable).alias("answerable"))
    made = F.array(
        one(say("According to ", F.col("title"), ", what holds for ", section, "?"), "factual", "easy", True),
        one(say("Which steps does ", F.col("title"), " give under ", section, "?"), "how_to", "medium", True),
        one(say("On what date will ", F.col("title"), " next be revised?"), "unanswerable", "hard", False),
    )
    rows = chunks.select("chunk_id", "title", reference.alias("_r"), F.explode(made).alias("c")).select(
        F.sha2(F.concat_ws("|", F.col("chunk_id").cast("string"), "c.question"), 256).alias("case_id"), "c.*",
        F.when(F.col("c.answerable"), F.col("_r")).otherwise("The documents say nothing about later revisions.").alias("reference_answer"),
        F.when(F.col("c.answerable"), F.array(F.col("chunk_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("relevant_chunk_ids"),
    )
    pair = Window.partitionBy("document_id").orderBy("chunk_index")
    follows = chunks.withColumns({"_t": F.lead("title").over(pair), "_c": F.lead("chunk_id").over(pair), "_x": F.lead("content").over(pair)}).filter("_c is not null")
    hops = follows.select(
        F.sha2(F.concat_ws("|", F.col("chunk_id").cast("string"), F.col("_c").cast("string")), 256).alias("case_id"), say("What connects ", F.col("title"), " with ", F.col("_t"), "?").alias("question"),
        F.lit("multi_hop").alias("category"), F.lit("hard").alias("difficulty"), F.lit(True).alias("answerable"), F.concat_ws(" ", T.first_sentences("content"), T.first_sentences("_x")).alias("reference_answer"), F.array(F.col("chunk_id").cast("string"), F.col("_c").cast("string")).alias("relevant_chunk_ids"),
    )
    return rows.unionByName(hops)
