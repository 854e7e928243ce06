"""Grade responses as their files arrive (the streaming form of "resume").

New response files in a folder are a file stream; keyword rules are a
static table joined to it (stream-static join; the planner builds the side of
the rules where it is small); the per-response fold is stateless, so each micro-batch is
scored independently and appended to the ``metric_scores`` table. Progress
lives in a checkpoint under the cluster's shared ``spark.checkpoint.dir``,
so a restarted or re-scheduled job continues where it stopped and an
executor loss only re-runs the affected tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewise.operators import keywords as kw
from gradewise.session import checkpoint_dir

RESPONSE_SCHEMA = "doc_id long, model string, case_id long, sample_no long, text string"


def response_stream(spark: SparkSession, folder: str, schema: str = RESPONSE_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def scored_stream(responses: DataFrame, rules: DataFrame) -> DataFrame:
    s = kw.keyword_scores(responses, rules)
    return s.select("model", "case_id", "sample_no", F.lit("keywords").alias("metric"), "score", "tot")


def start_grading(spark: SparkSession, folder: str, rules: DataFrame, out_path: str,
                  name: str = "keyword_grading", available_now: bool = False):
    """Start the streaming job; returns the StreamingQuery."""
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = (scored_stream(response_stream(spark, folder), rules).writeStream
         .format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).option("path", out_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
