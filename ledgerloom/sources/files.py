"""CSV files: expense files in, result files out."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions.text import compose_result, is_csv_name
from ledgerloom.operators.mapping import blank_cells

CORRUPT = "_corrupt_record"
CSV_GLOB = "*.[cC][sS][vV]"
RESULT_COLUMN = "resultado_validacion"


def admissible_files(files: DataFrame, name: str = "filename") -> DataFrame:
    """S-02"""
    return files.where(is_csv_name(F.col(name)))


def headers_of(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Every header under ``path`` with its files: the first non-blank line of each file.

    Headers and file names are few beside the rows; Spark's scan lists the files on the
    driver as well.
    """
    lines = spark.read.option("pathGlobFilter", CSV_GLOB).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    first = (
        lines.select("value", at.alias("at"), F.col("_metadata.file_path").alias("file"))
        .where(F.trim(F.regexp_replace("value", "\ufeff", "")) != "")
        .groupBy("file")
        .agg(F.min_by("value", "at").alias("value"))
    )
    files: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(first.collect()):
        header = tuple(c.strip() for c in next(csv.reader([r.value.lstrip("\ufeff")])))
        files.setdefault(header, []).append(r.file)
    if not files:
        raise ValueError(f"no CSV rows under {path}")
    return files


def unique_names(header: list[str]) -> list[str]:
    """Names Spark can tell apart; of columns that clash only the last keeps its name."""
    last = {name.lower(): i for i, name in enumerate(header)}
    return [name if last[name.lower()] == i else f"_shadowed_{i}" for i, name in enumerate(header)]


def _scan(spark: SparkSession, header: list[str], files: list[str], mode: str, multi_line: bool) -> DataFrame:
    """The rows of the files that share one header."""
    names = unique_names(header)
    usable = [n for n in names if not n.startswith("_shadowed_")]
    schema = StructType([StructField(n, StringType()) for n in names])
    if mode == "PERMISSIVE":
        schema = schema.add(CORRUPT, StringType())
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("multiLine", multi_line)
        .csv(files)
    )
    extra = [CORRUPT] if mode == "PERMISSIVE" else []
    return blank_cells(df, usable).select(*[f"`{n}`" for n in usable], *extra, F.col("_metadata").alias("_file"))


def read_expense_csv(
    spark: SparkSession, path: str, mode: str = "PERMISSIVE", multi_line: bool = True
) -> tuple[DataFrame, list[str]]:
    """S-01: (text cells plus ``_corrupt_record`` and ``_file``, names of the usable columns).

    Every file is read under its own header, whatever the order or names of its columns; a
    column that a file lacks is null in its rows, an empty cell is ''.  ``FAILFAST``
    aborts on the first malformed row.  Quoted cells may hold line breaks; with
    ``multi_line=False`` they may not, and large files are read in splits.
    """
    parts = []
    for header, files in headers_of(spark, path).items():
        parts.append(_scan(spark, list(header), files, mode, multi_line))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows, [c for c in rows.columns if c not in (CORRUPT, "_file")]


def result_text(status: Column, alerts: Column) -> Column:
    """F-21 on alert structs."""
    return compose_result(status, F.transform(alerts, lambda a: a["mensaje"]))


def write_results_csv(rows: DataFrame, path: str) -> None:
    """K-07: CSV with a ``resultado_validacion`` column, quoted because messages hold commas."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_results_csv(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, list[str]]:
    """S-08: a results file, its golden column as text, and the names of its columns."""
    rows, columns = read_expense_csv(spark, path, multi_line=multi_line)
    if RESULT_COLUMN not in columns:
        raise ValueError(f"{RESULT_COLUMN} es requerida para los casos históricos")
    return rows.drop(CORRUPT, "_file"), columns
