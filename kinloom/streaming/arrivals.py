"""Records that arrive as a stream, assigned to the clusters of an earlier resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.functions.dictionaries import Dictionaries
from kinloom.operators import matching
from kinloom.operators.prepare import prepare


def assign_arrivals(arrivals: DataFrame, clusters: DataFrame, prepared: DataFrame, dictionaries: Dictionaries, out: str, checkpoint: str, json_rules: list[dict] | None = None) -> StreamingQuery:
    """Start a query that gives each arriving record its best cluster, or none.

    Each micro-batch is one batch resolution step, written to its own folder of ``out`` under the batch's number, so a
    batch that is repeated after a failure replaces its own rows: the result is exactly once. Ids of arrivals must not
    occur in ``prepared``. Late records need no watermark: no state is kept between batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{out}/batch={number}"
        prepare(batch, dictionaries).write.mode("overwrite").parquet(f"{checkpoint}/prepared")
        new = spark.read.parquet(f"{checkpoint}/prepared")
        both = prepared.unionByName(new, allowMissingColumns=True)
        found = matching.assign(new, clusters, both, dictionaries, json_rules).select("idx", "cluster_id", "score", "rule")
        rows = new.select("idx", "record_id").join(found, "idx", "left")
        rows.select("record_id", "cluster_id", F.coalesce("score", F.lit(0.0)).alias("score"), "rule").write.mode("overwrite").parquet(folder)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/offsets").trigger(availableNow=True).start()
