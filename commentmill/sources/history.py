"""The run history: an append-only Parquet table partitioned by day, with a version per
rewrite, and the reports read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commentmill.functions.numbers import ratio
from commentmill.functions.text import strip
from commentmill.operators.rows import is_toxic, preview, scores_line, with_row_id

RUN_SCHEMA = (
    "id bigint, user_id bigint, run_type string, source_filename string, row_count bigint, "
    "toxic_count bigint, non_toxic_count bigint, summary string, created_at timestamp, "
    "results_path string"
)
RUN_COLUMNS = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
LIST_LIMIT = 200
NO_RESULT = "(No analysis result saved for this run.)"


class RunHistory:
    """A folder of versions ``v=0, v=1, ...``. Appends go to the newest one; deletes and
    updates write the next one and leave the old for readers that still use it. One writer at
    a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=")
                      and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _folder(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return self.spark.read.schema(RUN_SCHEMA + ", day date").parquet(
            self._folder(versions[-1])).select(*RUN_COLUMNS)

    def _write(self, runs: DataFrame, version: int, mode: str) -> None:
        runs.withColumn("day", F.to_date("created_at")).write.mode(mode).partitionBy(
            "day").parquet(self._folder(version))

    def append(self, runs: DataFrame) -> int:
        """Add runs (all columns but ``id``; time and path may be missing); first new id."""
        start = (self.read().agg(F.max("id")).first()[0] or 0)
        if "created_at" not in runs.columns:
            runs = runs.withColumn("created_at", F.date_trunc("second", F.current_timestamp()))
        if "results_path" not in runs.columns:
            runs = runs.withColumn("results_path", F.lit(None).cast("string"))
        numbered = with_row_id(runs, "_n").withColumn("id", F.col("_n") + start)
        types = dict(c.split() for c in RUN_SCHEMA.split(", "))
        self._write(numbered.select(*[F.col(c).cast(types[c]).alias(c) for c in RUN_COLUMNS]),
                    (self._versions() or [0])[-1], "append")
        return start + 1

    def replace(self, runs: DataFrame) -> None:
        """Write a whole new version."""
        self._write(runs, (self._versions() or [-1])[-1] + 1, "errorifexists")

    def clear_user(self, user_id: int) -> int:
        """Delete one user's runs; how many there were."""
        runs = self.read()
        gone = runs.filter(F.col("user_id") == user_id).count()
        if gone:
            self.replace(without_user(runs, user_id))
        return gone

    def update_results_path(self, patch: DataFrame) -> None:
        """``patch``: (id, results_path)."""
        self.replace(with_results_path(self.read(), patch))


def without_user(runs: DataFrame, user_id: int) -> DataFrame:
    return runs.filter(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def with_results_path(runs: DataFrame, patch: DataFrame) -> DataFrame:
    new = patch.select("id", F.col("results_path").alias("_new"), F.lit(True).alias("_hit"))
    return runs.join(new, "id", "left").withColumn("results_path", F.when(
        F.col("_hit"), F.col("_new")).otherwise(F.col("results_path"))).select(*runs.columns)


def runs_of_user(runs: DataFrame, user_id: int, limit: int = LIST_LIMIT) -> DataFrame:
    """One user's newest runs."""
    return runs.filter(F.col("user_id") == user_id).orderBy(F.desc("id")).limit(limit)


def newest_runs_per_user(runs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest runs of every user; the limit is applied in the map tasks first."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return runs.withColumn("_r", F.row_number().over(newest)).filter(
        F.col("_r") <= limit).drop("_r")


def run_of_owner(runs: DataFrame, run_id: int, user_id: int) -> DataFrame:
    return runs.filter((F.col("id") == run_id) & (F.col("user_id") == user_id))


def totals(runs: DataFrame) -> DataFrame:
    """Sums over all runs, 0 for none, with toxic and non-toxic percent (one digit)."""
    sums = runs.agg(*[F.coalesce(F.sum(src), F.lit(0)).alias(out) for src, out in (
        ("row_count", "comments_analyzed"), ("toxic_count", "toxic_comments"),
        ("non_toxic_count", "non_toxic_comments"))])
    judged = F.col("toxic_comments") + F.col("non_toxic_comments")
    return sums.withColumns({
        f"{c}_percent": F.round(ratio(F.col(f"{c}_comments"), judged) * 100, 1)
        for c in ("toxic", "non_toxic")})


def timeline(runs: DataFrame, days: int = 30) -> DataFrame:
    """Rows analysed per day, the newest days, oldest first."""
    daily = runs.groupBy(F.to_date("created_at").alias("day")).agg(
        F.sum("row_count").alias("comments"))
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def summary_column(summary: Column) -> Column:
    """First line, trimmed; cut to 400 characters unless it is a scores line."""
    first = strip(F.get(_lines(F.coalesce(summary, F.lit(""))), F.lit(0)))
    return F.when(first.startswith("Overall:"), first).otherwise(F.substring(first, 1, 400))


def preview_body(summary: Column) -> Column:
    """The text below a leading scores line."""
    text = strip(F.coalesce(summary, F.lit("")))
    lines = _lines(text)
    below = strip(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
    headed = text.startswith("Overall:") | text.startswith("Single:")
    return (F.when(text == "", NO_RESULT)
            .when(headed & (below != ""), below).otherwise(text))


def dataset_run(summary: DataFrame, *, user_id: int, source_filename: str | None) -> DataFrame:
    """The run record of a dataset job from its summary row (with ``summary`` text)."""
    return summary.select(
        F.lit(user_id).cast("bigint").alias("user_id"), F.lit("dataset").alias("run_type"),
        F.lit(source_filename).cast("string").alias("source_filename"),
        F.col("analyzed").alias("row_count"), F.col("toxic").alias("toxic_count"),
        F.col("non_toxic").alias("non_toxic_count"), F.col("summary"))


def single_run(result: DataFrame, *, user_id: int, text: str,
               source_filename: str | None = None) -> DataFrame:
    """The run record of a single text. Toxicity is judged by the six scores alone."""
    toxic = is_toxic().cast("int")
    snippet = preview(F.trim(F.lit(text)), 500, tabs=False)
    summary = F.concat_ws("\n", scores_line(F.col("overall_score")),
                          F.concat(F.lit("- Level: "), F.col("level")),
                          F.concat(F.lit("Text preview: "), snippet))
    return result.select(
        F.lit(user_id).cast("bigint").alias("user_id"), F.lit("single").alias("run_type"),
        F.lit(source_filename).cast("string").alias("source_filename"),
        F.lit(1).cast("bigint").alias("row_count"), toxic.cast("bigint").alias("toxic_count"),
        (1 - toxic).cast("bigint").alias("non_toxic_count"), summary.alias("summary"))
