"""New yearly claim files scored as they arrive, by the same stateless flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docketry.plans.scoring import score_patent_claims
from docketry.sources.writers import predictions_only


def score_new_files(
    spark: SparkSession, landed: str, schema, patent_ids: DataFrame, model, out: str, checkpoint: str
) -> StreamingQuery:
    """Score the files that are new under ``landed`` since the last run and append the predictions."""
    claims = spark.readStream.schema(schema).parquet(landed)
    scored = predictions_only(score_patent_claims(claims, patent_ids, model))
    return (
        scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
