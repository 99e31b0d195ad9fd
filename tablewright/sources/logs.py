"""Training logs as a table of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.running import running_sums

# Lines of the log format. Fixed values.
ROUND_HEADER = r"--- 世代 (\d+)/\d+ ---"
AUC_LINE = r"\[统计\] 平均基础AUC: ([\d\.]+) \(最高: ([\d\.]+)\)"
SCORE_LINE = r"\[统计\] 平均综合得分: ([\d\.]+) \(最高: ([\d\.]+)\)"


def parse_training_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, round, best_auc, mean_auc, best_score``: one row per round that reports an AUC.

    Only header and statistics lines leave the scan. A line belongs to the last
    header before it in its file: headers are counted in line order, and the
    running count numbers the block. The first statistics line of a block counts;
    a round without a score line has score 0.
    """
    text = F.col("value")
    lines = (
        spark.read.text(path)
        .filter(text.rlike(ROUND_HEADER) | text.rlike(AUC_LINE) | text.rlike(SCORE_LINE))
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            F.nullif(F.regexp_extract(text, ROUND_HEADER, 1), F.lit("")).cast("int").alias("header"),
            F.nullif(F.regexp_extract(text, AUC_LINE, 1), F.lit("")).try_cast("double").alias("mean_auc"),
            F.nullif(F.regexp_extract(text, AUC_LINE, 2), F.lit("")).try_cast("double").alias("best_auc"),
            F.nullif(F.regexp_extract(text, SCORE_LINE, 2), F.lit("")).try_cast("double").alias("best_score"),
        )
        .withColumn("is_header", F.col("header").isNotNull().cast("long"))
    )
    numbered = running_sums(lines, ["block", "line"], ["is_header"], ["file"]).filter(F.col("is_header_upto") > 0)
    at = F.struct("block", "line")

    def first(name: str):
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), at))

    return (
        numbered.groupBy("file", F.col("is_header_upto").alias("_block"))
        .agg(
            F.max("header").alias("round"),
            first("best_auc").alias("best_auc"),
            first("mean_auc").alias("mean_auc"),
            F.coalesce(first("best_score"), F.lit(0.0)).alias("best_score"),
        )
        .filter(F.col("best_auc").isNotNull())
        .drop("_block")
    )
