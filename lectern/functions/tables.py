"""Table functions for SQL, registered for a session; their columns follow from the table that they are called with."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

RRF_K = 60


def _field(table: AnalyzeArgument, name: str):
    if not table.isTable:
        raise ValueError("a table is asked for, as in f(TABLE(t))")
    found = next((f for f in table.dataType.fields if f.name == name), None)
    if found is None:
        raise ValueError(f"the table has no column {name}")
    return found


class RankedFusion:
    """Reciprocal rank fusion of the channels in a table (query_id, channel, chunk_id, rank): (query_id, chunk_id, fused_score, fused_rank).

    A query is a partition. Of a channel's rows of one chunk the best rank counts; equal scores go by best rank, then by chunk.
    """

    def __init__(self):
        self.query, self.best = None, {}

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name in ("channel", "rank"):
            _field(rows, name)
        schema = StructType([_field(rows, "query_id"), _field(rows, "chunk_id")]).add("fused_score", DoubleType()).add("fused_rank", IntegerType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("rank"), OrderingColumn("chunk_id")])

    def eval(self, row, k=RRF_K):
        self.query, self.k = row["query_id"], k
        if row["rank"] is not None:
            self.best.setdefault(row["chunk_id"], {}).setdefault(row["channel"], row["rank"])

    def terminate(self):
        made = sorted((-round(sum(1 / (self.k + r) for r in ranks.values()), 12), min(ranks.values()), chunk) for chunk, ranks in self.best.items())
        for place, (score, _, chunk) in enumerate(made, 1):
            yield self.query, chunk, -score, place


class NewestRows:
    """Of a table with the columns ``id`` and ``at``, the row of the greatest ``at`` of each id, in the table's own columns."""

    def __init__(self):
        self.last = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _field(rows, "id")
        _field(rows, "at")
        return AnalyzeResult(schema=rows.dataType, partitionBy=[PartitioningColumn("id")], orderBy=[OrderingColumn("at")])

    def eval(self, row):
        self.last = row

    def terminate(self):
        if self.last is not None:
            yield tuple(self.last)


def register(spark: SparkSession) -> None:
    """``ranked_fusion`` and ``newest_rows`` for this session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("ranked_fusion", udtf(RankedFusion))
    spark.udtf.register("newest_rows", udtf(NewestRows))
