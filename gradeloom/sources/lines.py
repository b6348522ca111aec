"""Text lines whose position is their key."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.operators.row_index import position_in_partition
from gradeloom.staging import stage

_BLOCK = ("_file", "_start")


def _blank() -> Column:
    return F.col("value").rlike(r"^ *$")


def _numbered_scan(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """Lines with their block of the file and a number that grows within it."""
    lines = spark.read.text(path)
    if skip_blank:
        lines = lines.filter(~_blank())
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_task_row"),
    )


def indexed_lines(spark: SparkSession, path: str, header_lines: int = 0, skip_blank: bool = False) -> DataFrame:
    """Lines as ``value`` with their position over all files as ``row_idx``.

    Files are in path order.  ``header_lines`` lines at the top of every file
    are left out and not counted, and neither are blank lines if they are
    skipped.  A first pass counts the lines of every
    block; the second adds the lines of the blocks before to the position
    within the block, so no line is moved.
    """
    header = F.when(F.col("_start") == 0, F.lit(header_lines)).otherwise(F.lit(0))
    blocks = (
        _numbered_scan(spark, path, skip_blank)
        .groupBy(*_BLOCK)
        .agg(F.min("_task_row").alias("_first"), F.count("*").alias("_lines"))
        .withColumn("_kept", F.greatest(F.col("_lines") - header, F.lit(0)))
    )
    # One row per split, a list that the driver holds to schedule the scan.
    earlier = Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_kept").over(earlier), F.lit(0))).drop("_kept")
    offsets = stage(offsets.withColumn("_key", F.xxhash64("_file")), "offsets")
    if offsets.groupBy("_key").agg(F.count_distinct("_file").alias("_files")).filter("_files > 1").head(1):
        raise ValueError(f"two files of {path} have the same hash of their path; rename one")
    # A few numbers for each split of the scan, so that the lines stay where they are read.
    offsets = F.broadcast(offsets.select("_key", "_start", "_first", "_lines", "_before"))
    position = F.col("_task_row") - F.col("_first")
    moved = F.raise_error(F.lit("the files or their splits changed while they were read")).cast("long")
    known = F.coalesce((position >= 0) & (position < F.col("_lines")), F.lit(False))
    return (
        _numbered_scan(spark, path, skip_blank)
        .withColumn("_key", F.xxhash64("_file"))
        .join(offsets, ["_key", "_start"], "left")
        .withColumn("_position", F.when(known, position).otherwise(moved))
        .filter(F.col("_position") >= header)
        .select((F.col("_before") + F.col("_position") - header).alias("row_idx"), "value")
    )


def read_indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prediction lines: trimmed, cast to int, keyed by position.

    A line that is not a whole number fails.
    """
    lines = indexed_lines(spark, path).withColumn("value", F.btrim("value", F.lit(" \t\r\f\v")))
    bad = F.raise_error(F.concat(F.lit("not a label: "), F.col("value"))).cast("int")
    return lines.select("row_idx", F.coalesce(F.col("value").try_cast("int"), bad).alias("value"))


def lines_after(spark: SparkSession, path: str, skip_lines: int, drop_first_row: bool = False) -> DataFrame:
    """Lines of a table without blank ones and without the first ``skip_lines``.

    ``drop_first_row`` also drops the first line that is left.  The skipped
    lines lie at the top of the first file, which its own first task reads, so
    no position has to be worked out for the rest.
    """
    head, head_path = _first_file(spark, path)
    out_of_place = F.raise_error(F.lit("the first lines are spread over several blocks")).cast("boolean")
    skipped = F.col("_task_row") < skip_lines
    kept = head.filter(F.when(skipped & (F.col("_start") > 0), out_of_place).otherwise(~skipped))
    kept = kept.filter(~_blank())
    if drop_first_row:
        first = kept.select("_task_row").head(1)
        if first:
            kept = kept.filter(F.col("_task_row") != first[0][0])
    if head_path is None:
        return kept.select("value")
    others = spark.read.text(path).filter(F.col("_metadata.file_path") != head_path).filter(~_blank())
    return kept.select("value").unionByName(others.select("value"))


def _first_file(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Scan of the first file that has lines, and its path if there are others."""
    scan, named = _numbered_scan(spark, path), None
    files = sorted(spark.read.text(path).inputFiles())
    if len(files) == 1:
        return scan, named
    for file in files:
        scan = _numbered_scan(spark, unquote(file))
        first = scan.select("_file").head(1)
        if first:
            named = first[0][0]
            break
    return scan, named


def write_label_lines(df: DataFrame, path: str, column: str = "prediction", single_file: bool = False) -> None:
    """One label per line in the order of ``row_idx``, in part files of that order.

    ``single_file`` passes all lines through one task.
    """
    lines = df.orderBy("row_idx").select(F.col(column).cast("string").alias("value"))
    (lines.coalesce(1) if single_file else lines).write.text(path)
