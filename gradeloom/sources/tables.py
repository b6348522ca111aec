"""Corpora, split lists, unlabelled and augmented texts."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators.sampling import concat
from gradeloom.sources.lines import indexed_lines, lines_after
from gradeloom.sources.quoted_records import read_records, splits_of
from gradeloom.staging import stage

CORRUPT = "_corrupt_record"
CORPUS = "par_id bigint, art_id string, keyword string, country_code string, text string, label int"
UNLABELLED = "par_id string, art_id string, keyword string, country_code string, text string"
SPLIT_LABELS = "par_id bigint, label string"
AUGMENTED = "par_id bigint, label string, text string"

# The fields that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _known(column: str) -> Column:
    return F.when(~F.col(column).isin(*MISSING), F.col(column))


def _parse(lines: DataFrame, schema: str, sep: str, quote: str, *keep: str, keep_corrupt: bool = False) -> DataFrame:
    """Fields of every line; missing ones are null, odd lines are kept as corrupt records."""
    types = dict(field.strip().split(" ") for field in schema.split(","))
    as_text = ", ".join(f"{name} string" for name in types)
    options = {"sep": sep, "quote": quote, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(*keep, F.from_csv("value", f"{as_text}, {CORRUPT} string", options).alias("row"), "value")
    fields = parsed.select(*keep, "row.*", "value").withColumns({name: _known(name) for name in types})
    numbers = {name: F.col(name).try_cast(kind) for name, kind in types.items() if kind != "string"}
    bad_number = F.lit(False)
    for name, number in numbers.items():
        bad_number = bad_number | (F.col(name).isNotNull() & number.isNull())
    corrupt = F.when(F.col(CORRUPT).isNotNull() | bad_number, F.col("value"))
    checked = fields.withColumn(CORRUPT, corrupt).withColumns(numbers)
    return checked.select(*keep, *types, *([CORRUPT] if keep_corrupt else []))


def read_corpus(
    spark: SparkSession,
    path: str,
    skip_lines: int = 2,
    header: str = "none",
    quote: str = "",
    keep_corrupt: bool = False,
) -> DataFrame:
    """Annotated corpus: tab-separated, six columns, lines on top to skip.

    ``header="consume"`` drops one more row, as a reader does that takes it for
    column names.  Lines are parsed one by one, so that a stray quote cannot
    merge them and large files are split.
    """
    if header not in ("none", "consume"):
        raise ValueError('header is "none" or "consume"')
    lines = lines_after(spark, path, skip_lines, drop_first_row=header == "consume")
    return _parse(lines, CORPUS, "\t", quote, keep_corrupt=keep_corrupt)


def read_split_labels(spark: SparkSession, path: str) -> DataFrame:
    """Split list: CSV with header, as ``row_idx``, ``par_id``, ``label``."""
    lines = indexed_lines(spark, path, header_lines=1, skip_blank=True)
    return _parse(lines, SPLIT_LABELS, ",", '"', "row_idx")


def read_unlabelled(spark: SparkSession, path: str, quote: str = "", positions: bool = False) -> DataFrame:
    """Unlabelled texts: tab-separated, five columns, no header.

    ``positions`` adds ``row_idx``, the order that predictions are written in.
    """
    if positions:
        rows = _parse(indexed_lines(spark, path, skip_blank=True), UNLABELLED, "\t", quote, "row_idx")
        return rows.select("row_idx", "par_id", "text")
    return _parse(lines_after(spark, path, skip_lines=0), UNLABELLED, "\t", quote).select("par_id", "text")


def read_augmented(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files of a folder, each with a header; sub-folders are left out.

    The file name becomes ``copy_no`` unless the file has one.  Files may order their
    columns differently and may lack some.  A folder without files gives no rows; files
    with names that Spark passes over fail.  Large files are read by many tasks, whether their
    texts have line breaks or not; a header is one line.
    """
    _refuse_hidden_files(spark, path)
    splits = stage(splits_of(spark, path), "states")
    records = read_records(spark, path, splits)
    # One row per file, like the list of files the driver holds anyway.
    first = splits.filter("header IS NOT NULL").select("file", "header").collect()
    if not first:
        return spark.createDataFrame([], f"{AUGMENTED}, origin string, copy_no string")
    files = [(row["file"], row["header"].removesuffix("\r"), unquote(row["file"]).rsplit("/", 1)[-1]) for row in first]
    headers = F.broadcast(spark.createDataFrame(files, "file string, header string, file_name string"))
    rows = records.filter("start > 0 OR at > 0").join(headers, "file")
    return concat(*(_parse_csv(rows.filter(F.col("header") == header), header) for header in sorted({h for _, h, _ in files})))


def _refuse_hidden_files(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isFile()]
    hidden = sorted(name for name in names if name[0] in "._" and name.endswith(".csv"))
    if hidden:
        raise ValueError(f"{path} has files that Spark does not read because of their names: {', '.join(hidden)}")


def _parse_csv(rows: DataFrame, header: str) -> DataFrame:
    """Fields of the records of all files with this header."""
    names = [name.strip().strip('"') for name in header.lstrip("\ufeff").split(",")]
    schema = ", ".join(f"`{name}` string" for name in names)
    # Line breaks in quotes stay as they are.
    fields = F.from_csv("value", schema, {"escape": '"', "multiLine": "true"})
    parsed = rows.select(fields.alias("row"), "file_name")
    types = {"par_id": "bigint"}
    known = {name: _known(f"row.`{name}`") for name in names}
    columns = [known[name].cast(types.get(name, "string")).alias(name) for name in names]
    added = {"origin": F.lit("aug"), "copy_no": F.col("file_name")}
    return parsed.select(
        *(c for name, c in zip(names, columns) if name not in added),
        # What the file says comes first.
        *(F.coalesce(known[name], value).alias(name) if name in names else value.alias(name) for name, value in added.items()),
    )


def write_augmented(df: DataFrame, path: str, mode: str = "error", failed_path: str | None = None) -> None:
    """Augmented rows as CSV files with header; the id is written too.

    Rows with an ``error`` have no text and are written to ``failed_path`` only, if given.
    """
    if "error" in df.columns:
        df = stage(df, "augmented")
        if failed_path is not None:
            failed = df.filter(F.col("error").isNotNull())
            failed.write.mode(mode).options(header=True, escape='"').csv(failed_path)
        df = df.filter(F.col("error").isNull()).drop("error")
    df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
