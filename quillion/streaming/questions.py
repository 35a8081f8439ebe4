"""Questions that arrive as files, answered batch by batch (beyond what a request needs).

The query's checkpoint makes batches repeatable: a batch is written under its
number, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillion.plans.research import Results


def answer(spark: SparkSession, incoming: str, out: str, checkpoint: str, plan: Callable[[DataFrame], Results], files_per_batch: int = 16) -> StreamingQuery:
    """Start answering JSON files of (qid, question) that appear in ``incoming``."""
    stream = spark.readStream.schema("qid string, question string").option("maxFilesPerTrigger", files_per_batch).json(incoming)

    def batch(questions: DataFrame, number: int) -> None:
        r = plan(questions)
        r.papers.write.mode("overwrite").parquet(f"{out}/papers/batch={number}")
        r.provider_status.write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        r.release()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fused(papers: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of the sources' own positions (provider_ranks), as fused_score."""
    from pyspark.sql import functions as F

    return papers.withColumn("fused_score", F.aggregate(F.map_values("provider_ranks"), F.lit(0.0), lambda a, r: a + 1.0 / (F.lit(k) + r)))
