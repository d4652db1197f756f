"""Dataset readers and writers."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENT = "comment_text"
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".txt": "text"}
# Line ends besides \n and \r that cut a text file into comments.
OTHER_LINE_ENDS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *,
             multiline: bool = False, strict: bool = False) -> DataFrame:
    """Header row, quoted cells with doubled quotes. Quoted line breaks need ``multiline``,
    which reads a file in one task. With ``strict`` a malformed row is an error, else its cells
    are null. Give a schema: inferring one reads the data twice."""
    reader = spark.read.options(header=True, multiLine=multiline, quote='"', escape='"',
                                mode="FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader.option(
        "inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *,
              lines: bool = True, strict: bool = False) -> DataFrame:
    """One record per line, which can be split, or an array of records per file (``lines=False``,
    one task per file). With ``strict`` a malformed record is an error."""
    reader = spark.read.options(multiLine=not lines, allowSingleQuotes=False,
                                mode="FAILFAST" if strict else "PERMISSIVE")
    return (reader if schema is None else reader.schema(schema)).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One line is one comment, blank lines included; broken UTF-8 is replaced."""
    line = F.make_valid_utf8(F.col("value"))
    return spark.read.text(path).select(F.explode(F.split(line, OTHER_LINE_ENDS)).alias(COMMENT))


def load_dataset(spark: SparkSession, path: str, format: str | None = None,
                 schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read by extension (or by ``format``: csv, json, jsonl, text, parquet)."""
    kind = format or FORMATS.get(PurePosixPath(path).suffix.lower())
    if kind == "csv":
        return read_csv(spark, path, schema, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, schema, **{"lines": kind == "jsonl", **options})
    if kind == "text":
        return read_text(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def flat_columns(df: DataFrame) -> DataFrame:
    """Lists become comma-separated text, as a delimited file needs."""
    return df.select(*[
        F.array_join(F.col(f.name), ", ").alias(f.name)
        if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The dataset with its derived columns, written in parallel as CSV parts."""
    flat_columns(df).write.mode(mode).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def export_row_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Row results as tab-separated parts with a header."""
    flat_columns(results).write.mode(mode).options(
        header=True, sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False).csv(path)
