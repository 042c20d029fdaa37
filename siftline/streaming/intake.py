"""Continuous intake: a stream of listings is scored as it arrives."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators.ranking import run_summary
from siftline.operators.report import ranked_report, render_markdown
from siftline.functions.text import strip
from siftline.plans.run import score_listings
from siftline.schemas import LISTING
from siftline.sources.settings import Settings


def clean_intake(df: DataFrame, run_date: dt.date) -> DataFrame:
    """Intake rows: title, company and text stripped and required, dated with the run."""
    cleaned = df.withColumns({c: strip(F.col(c)) for c in ("title", "company", "description")})
    complete = (F.col("title") != "") & (F.col("company") != "") & (F.col("description") != "")
    return cleaned.where(complete).withColumns(
        {"location": F.lit(""), "url": F.lit(""), "date_posted": F.lit(run_date.isoformat())}
    )


def stream_run(
    stream: DataFrame,
    settings: Settings,
    scorer: Callable[[str], str],
    out: str,
    checkpoint: str,
    run_date: dt.date,
    batch_size: int | None = None,
) -> None:
    """Score all listings that are available and stop.

    Every micro-batch writes its own ``run_id`` partition under ``out``; when a
    micro-batch is repeated after a failure it replaces that partition.
    """

    def score_micro_batch(rows: DataFrame, batch_id: int) -> None:
        scored = score_listings(clean_intake(rows, run_date), settings, scorer, batch_size)
        (
            scored.withColumn("run_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id")
            .parquet(out)
        )

    query = (
        stream.writeStream.foreachBatch(score_micro_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_listing_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Stream of listing files (JSON lines) that arrive in a folder."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", max_files).json(path)


def session_report(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report rows and counts over all micro-batches so far."""
    untiered = results.withColumn("location_tier", F.lit(None).cast("int")).withColumn("location_note", F.lit(""))
    scored = untiered.where(F.col("result_type") == "scored")
    return render_markdown(ranked_report(scored)), run_summary(untiered)
