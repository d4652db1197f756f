"""Finding the text and label columns, and checking a training pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentmill.functions.text import as_text

MAX_CLASSES = 50
# Columns estimated above this are not label candidates; the estimate is within a few
# percent, so no column of at most 50 values is lost.
CANDIDATE_ESTIMATE = 100
_COUNTABLE = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def _facts(df: DataFrame, skip_counts: bool = False) -> tuple[int, dict[str, float], dict[str, int]]:
    """Rows, mean text length of every string column, and the exact number of values of every
    column that has few; two passes.

    An exact distinct count of all columns at once repeats the table once per column. A
    sketch pass first leaves out the wide columns; for the others partial aggregation keeps
    at most about a hundred values per task.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = [] if skip_counts else [f.name for f in df.schema.fields if not isinstance(f.dataType, _COUNTABLE)]
    one = df.agg(F.count(F.lit(1)).alias("n"),
                 F.struct(F.lit(0), *[F.avg(F.length(as_text(F.col(c)))).alias(c) for c in texts]).alias("len"),
                 F.struct(F.lit(0), *[F.approx_count_distinct(c).alias(c) for c in names]).alias("est")).first()
    few = [c for c in names if one["est"][c] <= CANDIDATE_ESTIMATE]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in few]).first() if few else {}
    return one["n"], {c: one["len"][c] or 0.0 for c in texts}, {c: exact[c] for c in few}


def _text_of(df: DataFrame, lengths: dict[str, float]) -> str:
    return max(lengths, key=lengths.get) if lengths else df.columns[0]


def _label_of(df: DataFrame, text_col: str, n: int, counts: dict[str, int]) -> str:
    top = min(MAX_CLASSES, max(2, int(n * 0.3)))
    fit = [c for c in counts if c != text_col and 2 <= counts[c] <= top]
    if fit:
        return min(fit, key=counts.get)
    return df.columns[1] if len(df.columns) > 1 else df.columns[0]


def detect_text_column(df: DataFrame) -> str:
    """The string column with the longest values on average; the first column if none."""
    return _text_of(df, _facts(df, skip_counts=True)[1])


def detect_label_column(df: DataFrame, text_col: str) -> str:
    """The column with the fewest values, between 2 and min(50, 30 % of the rows)."""
    n, _, counts = _facts(df)
    return _label_of(df, text_col, n, counts)


def profile_columns(df: DataFrame) -> DataFrame:
    """One line per column: position, name, mean text length, number of values where small,
    role (text, label or empty)."""
    n, lengths, counts = _facts(df)
    text_col = _text_of(df, lengths)
    roles = {_label_of(df, text_col, n, counts): "label", text_col: "text"}
    rows = [(i, c, lengths.get(c), counts[c] if counts.get(c, 99) <= MAX_CLASSES else None,
             roles.get(c, "")) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, mean_length double, n_values bigint, role string")


def validate_training_pair(df: DataFrame, text_col: str, label_col: str) -> tuple[bool, str]:
    """(ok, reason) before a model is trained on the pair."""
    if text_col == label_col:
        return False, "the text column and the label column must be different"
    label = as_text(F.col(label_col))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("labels")).first()
    n, labels = row["rows"], row["labels"]
    if n == 0:
        return False, "there are no rows to train on"
    if n >= 20 and labels / n >= 0.85:
        return False, f"the label column has {labels} values in {n} rows; it looks like text"
    if labels > MAX_CLASSES:
        head = df.select(label.alias("l")).limit(200).agg(F.avg(F.length("l")).alias("m")).first()
        if head["m"] > 80:
            return False, "the label values look like long text, not class names"
    return True, ""
