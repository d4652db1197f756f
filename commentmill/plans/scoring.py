"""Dataset scoring: sample, clean, pack into batches, score, parse, retry, summarise.

The scorer is a parameter. ``scorer_factory()`` is called once per Python worker task and
returns ``score(prompt) -> raw answer``; ``score_batches`` runs it in ``mapInPandas``. A scorer
written as a column expression can be given instead, and then nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.cut import materialized
from commentmill.functions.text import W, WS, as_text, is_blank, strip
from commentmill.operators import parse, rows
from commentmill.operators.clean import CleanConfig, clean_expr

ScorerFactory = Callable[[], Callable[[str], str]]
# Rows are packed within fixed ranges of the row id, so batches do not depend on partitioning.
# A range holds this many full batches, so that its end leaves none of them short.
BATCHES_PER_RANGE = 16
MAX_BATCH_ROWS = 24
ROW_OVERHEAD_TOKENS = 16


def input_budget(context_tokens: int = 4096, prompt_tokens: int = 900) -> int:
    """Tokens left for the rows of one batch, after prompt and answer are reserved."""
    answer = max(512, min(4096, int(context_tokens * 0.25)))
    return max(512, int(context_tokens * 0.70) - prompt_tokens - answer)


def estimated_tokens(text: Column) -> Column:
    """Words and single symbols; pass your own expression to match a scorer's tokenizer."""
    # every word becomes one character, then spaces go: what is left is counted
    return F.length(F.regexp_replace(F.regexp_replace(text, f"{W}++", "x"), f"{WS}++", ""))


def prepared(df: DataFrame, text_col: str, cfg: CleanConfig, *, row_id: str = "row_id",
             **lists) -> DataFrame:
    """(row_id, raw, text) of the rows that are not blank: raw is trimmed and kept for
    previews, text is raw cleaned. Rows that cleaning empties keep an empty text."""
    source = as_text(F.col(text_col))
    kept = df.filter(~is_blank(source)).select(F.col(row_id).alias("row_id"),
                                               strip(source).alias("raw"))
    return kept.withColumn("text", strip(clean_expr(F.col("raw"), cfg, **lists)))


def pack(items: DataFrame, *, max_rows: int = 1, budget: int | None = None,
         tokens: Column | None = None) -> DataFrame:
    """Add ``batch_id``: greedy filling in row order up to a token budget and a row cap.

    Ranges of row ids are packed on their own. Only ids and token counts are gathered, a few
    hundred per range; one row per batch needs no gathering at all.
    """
    if not 1 <= max_rows <= MAX_BATCH_ROWS:
        raise ValueError(f"rows per batch must be from 1 to {MAX_BATCH_ROWS}")
    # Emptied rows are dropped without a filter on the text: a filter would be pushed below the
    # cleaning and clean every row twice.
    some = F.col("text") != ""
    if max_rows == 1:
        return items.withColumn("batch_id", F.explode(F.when(
            some, F.array(F.col("row_id").cast("string")))))
    limit = F.lit(input_budget() if budget is None else budget)
    cost = F.when(some, F.greatest(F.lit(1), (tokens if tokens is not None else estimated_tokens(
        F.col("text"))) + ROW_OVERHEAD_TOKENS))
    # The texts are dealt by range once; gathering the counts, joining the result back and
    # building the prompts all use that partitioning, whose size the session's settings decide.
    dealt = items.withColumn("pack_range", F.floor(
        (F.col("row_id") - 1) / (BATCHES_PER_RANGE * max_rows))).withColumn(
        "_cost", cost).repartition("pack_range")
    ranges = dealt.groupBy("pack_range").agg(F.sort_array(F.collect_list(F.when(
        F.col("_cost").isNotNull(), F.struct("row_id", F.col("_cost").alias("cost"))))).alias("_rows"))

    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(0).alias("batch"),
                     F.array().cast("array<int>").alias("out"))

    def place(s: Column, r: Column) -> Column:
        fresh = (s["n"] > 0) & ((s["tokens"] + r["cost"] > limit) | (s["n"] >= max_rows))
        batch = s["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, 1).otherwise(s["n"] + 1).alias("n"),
                        F.when(fresh, r["cost"]).otherwise(s["tokens"] + r["cost"]).alias("tokens"),
                        batch.alias("batch"), F.array_append(s["out"], batch).alias("out"))

    placed = ranges.select("pack_range", F.col("_rows.row_id").alias("_ids"),
                           F.aggregate("_rows", empty, place, lambda s: s["out"]).alias("_batches"))
    at = F.array_position("_ids", F.col("row_id")).cast("int")
    return dealt.join(placed, "pack_range").filter(at > 0).withColumn(
        "batch_id", F.concat_ws(".", "pack_range", F.get("_batches", at - 1))).drop(
        "_ids", "_batches", "_cost")


def batch_prompts(packed: DataFrame, instruction: str = "") -> DataFrame:
    """(batch_id, row_ids, prompt): the instruction, then ``id: text`` lines in row order."""
    line = F.concat(F.col("row_id").cast("string"), F.lit(": "),
                    strip(F.translate("text", "\r\n", "  ")))
    if "pack_range" not in packed.columns:  # one row per batch
        return packed.select("batch_id", F.array("row_id").alias("row_ids"),
                             F.concat(F.lit(instruction), line).alias("prompt"))
    lines = packed.select("pack_range", "batch_id", F.struct("row_id", line.alias("line")).alias("r"))
    grouped = lines.groupBy("pack_range", "batch_id").agg(
        F.sort_array(F.collect_list("r")).alias("rs"))
    return grouped.select("batch_id", F.col("rs.row_id").alias("row_ids"), F.concat(
        F.lit(instruction), F.array_join(F.col("rs.line"), "\n")).alias("prompt"))


def score_batches(prompts: DataFrame, scorer: ScorerFactory | Column) -> DataFrame:
    """(batch_id, row_ids, raw, fault). A scorer that fails on a batch leaves its raw answer null
    and its message in ``fault``."""
    if isinstance(scorer, Column):
        return prompts.select("batch_id", "row_ids", scorer.alias("raw"),
                              F.lit(None).cast("string").alias("fault"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()

        def one(prompt: str) -> tuple[str | None, str | None]:
            try:
                return score(prompt), None
            except Exception as error:  # the batch is retried row by row, then reported
                return None, f"{type(error).__name__}: {error}"

        for b in batches:
            said = [one(p) for p in b["prompt"]]
            yield pd.DataFrame({"batch_id": b["batch_id"], "row_ids": b["row_ids"],
                                "raw": [s[0] for s in said], "fault": [s[1] for s in said]})

    return prompts.mapInPandas(run, "batch_id string, row_ids array<bigint>, raw string, fault string")


def batch_results(raw: DataFrame, *, keep_raw: bool = False) -> DataFrame:
    """One line per row a batch asked for: its validated analysis, or ``error``, the scorer's own
    message where it raised one."""
    lines = parse.expected_rows(raw)
    cols = ["row_id", "obj"] + (["raw"] if keep_raw else [])
    fault = ["fault"] if "fault" in lines.columns else []
    out = parse.analyses(lines.select(*cols, *fault)).drop("obj")
    if not fault:
        return out
    return out.withColumn("error", F.when(F.col("error").isNotNull(), F.coalesce("fault", "error"))).drop("fault")


@dataclass
class Scored:
    """results: one validated line per analysed row. failed: (row_id, error)."""

    prepared: DataFrame
    results: DataFrame
    failed: DataFrame


def score_dataset(items: DataFrame, scorer: ScorerFactory | Column, *, max_rows: int = 1,
                  budget: int | None = None, instruction: str = "", keep_raw: bool = False,
                  keep: Callable[[DataFrame], DataFrame] = materialized) -> Scored:
    """Score prepared rows (see ``prepared``).

    Rows that a batch left out or got wrong are scored again, one per batch; an invalid row
    does not cost its neighbours their results. Each pass is written to reliable storage: its
    lines are read several times, and the scorer, the expensive part, must run once.
    """

    def answers(packed: DataFrame) -> DataFrame:
        raw = score_batches(batch_prompts(packed, instruction), scorer)
        return keep(batch_results(raw, keep_raw=keep_raw))

    parse.allow_repeated_keys(items.sparkSession)
    if max_rows > 1:  # read by packing and by the retry: cleaned once
        items = keep(items)
    packed = pack(items, max_rows=max_rows, budget=budget)
    last = answers(packed)
    good = last.filter(F.col("error").isNull())
    if max_rows > 1:
        todo = last.filter(F.col("error").isNotNull()).select("row_id")
        again = items.join(todo, "row_id", "left_semi")
        last = answers(again.withColumn("batch_id", F.col("row_id").cast("string")))
        good = good.unionByName(last.filter(F.col("error").isNull()))
    failed = last.filter(F.col("error").isNotNull()).select("row_id", "error")
    return Scored(items, good.drop("error"), failed)


def row_results(scored: Scored) -> DataFrame:
    """The 12 export columns; empty name lists read ``None``."""
    source = scored.prepared.select("row_id", rows.preview(F.col("raw")).alias("text_preview"))

    def names(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("None")

    return scored.results.join(source, "row_id").select(
        F.col("row_id").alias("row_number"), F.col("overall_score").alias("overall"),
        *lex.SCORE_FIELDS, F.col("toxicity_level").alias("level"),
        names("category").alias("category"), names("toxicity_type").alias("toxicity_type"),
        "text_preview")


def top_examples(results: DataFrame, n: int = 5) -> DataFrame:
    """Highest overall scores above zero; the earlier row wins a tie."""
    return results.filter(F.col("overall") > 0).orderBy(F.desc("overall"), "row_number").limit(
        n).select("row_number", "overall", "text_preview")


def error_report(failed: DataFrame, shown: int = 20) -> DataFrame:
    """The first errors by row, and how many more there are."""
    more = F.lit(max(0, failed.count() - shown)).cast("bigint")
    return failed.orderBy("row_id").limit(shown).withColumn("n_more", more)


def summarize(source: DataFrame, text_col: str, scored: Scored, *, total_rows: int | None = None,
              row_id: str = "row_id") -> DataFrame:
    """One row: counts and half-even rounded means. ``rows`` is what was selected for scoring,
    ``rows_in_dataset`` the whole table. ``emptied`` counts rows that cleaning left blank: those
    that are neither blank nor among the scored lines, so nothing is cleaned again."""
    counts = source.agg(F.count(F.lit(1)).alias("rows"), F.count_if(
        is_blank(as_text(F.col(text_col)))).alias("skipped")).first()
    failed = scored.failed.count()
    n = F.count(F.lit(1))

    def number(x: int) -> Column:
        return F.lit(x).cast("bigint")

    kept = number(counts["rows"] - counts["skipped"] - failed)
    toxic = F.count_if(rows.is_toxic(overall=F.col("overall_score")))
    means = {c: F.rint(F.avg(c)).cast("int") for c in ("overall_score", *lex.SCORE_FIELDS)}
    return scored.results.agg(
        F.lit("Completed").alias("status"),
        number(counts["rows"] if total_rows is None else total_rows).alias("rows_in_dataset"),
        number(counts["rows"]).alias("rows"), n.alias("analyzed"),
        number(counts["skipped"]).alias("skipped"), (kept - n).alias("emptied"),
        number(failed).alias("errors"), toxic.alias("toxic"), (n - toxic).alias("non_toxic"),
        *[v.alias(f"avg_{c}") for c, v in means.items()])


def require_analyzed(summary: DataFrame) -> DataFrame:
    """An error when nothing could be analysed."""
    if summary.first()["analyzed"] <= 0:
        raise ValueError("every row was blank, emptied or failed: nothing to summarise")
    return summary


def summary_text(summary: DataFrame, *, source_name: str = "dataset",
                 text_col: str = "text") -> DataFrame:
    """The one-row summary plus its scores line and readable text."""
    avg = {c: F.col(f"avg_{c}") for c in lex.SCORE_FIELDS}
    line = rows.scores_line(F.col("avg_overall_score"), avg)
    facts = [("source", F.lit(source_name)), ("text in", F.lit(text_col)),
             ("state", F.col("status")), ("rows chosen", F.col("rows")), ("scored", F.col("analyzed")),
             ("blank", F.col("skipped")), ("emptied by cleaning", F.col("emptied")),
             ("failed", F.col("errors")), ("toxic", F.col("toxic")), ("not toxic", F.col("non_toxic")),
             *[(f"mean of {c.replace('_', ' ')}", F.concat(F.col(f"avg_{c}").cast("string"), F.lit("%")))
               for c in ("overall_score", *lex.SCORE_FIELDS)]]
    body = F.concat_ws("\n", F.lit("Scores of the dataset"),
                       *[F.concat(F.lit(f"* {k} = "), v.cast("string")) for k, v in facts])
    return summary.withColumns({"scores_line": line, "summary": F.concat_ws("\n", line, body)})


def full_report(source: DataFrame, text_col: str, scored: Scored, *, source_name: str = "dataset",
                shown: int = 20) -> DataFrame:
    """One row: ``report`` joins the summary, the five highest rows and the first failed rows with
    the number of the rest."""
    facts = summary_text(summarize(source, text_col, scored), source_name=source_name, text_col=text_col)
    top = [f"* row {r['row_number']} at {r['overall']}%: {r['text_preview']}"
           for r in top_examples(row_results(highest(scored))).collect()]
    lost = error_report(scored.failed, shown).collect()
    failed = [f"* row {r['row_id']}: {r['error']}" for r in lost]
    more = [f"* and {lost[0]['n_more']} more"] if lost and lost[0]["n_more"] else []
    parts = [*(["Highest rows", *top] if top else []), *(["Failed rows", *failed, *more] if failed else [])]
    return facts.withColumn("report", F.concat_ws("\n", "summary", *map(F.lit, parts)))


def highest(scored: Scored, n: int = 5) -> Scored:
    """Only the best ``n`` results, so that no other row needs its preview."""
    best = scored.results.filter(F.col("overall_score") > 0).orderBy(F.desc("overall_score"), "row_id").limit(n)
    return Scored(scored.prepared, best, scored.failed)


def single_text(spark, text: str, scorer: ScorerFactory | Column,
                cfg: CleanConfig | None = None) -> DataFrame:
    """Clean and score one text; its names joined with commas. Empty text is an error."""
    one = spark.createDataFrame([(1, text)], "row_id bigint, text string")
    items = prepared(one, "text", cfg or CleanConfig())
    if items.filter(F.col("text") != "").isEmpty():
        raise ValueError("there is no text to score")
    scored = score_dataset(items, scorer)
    if scored.results.isEmpty():
        raise ValueError("no valid answer came from the scorer")
    return scored.results.select(
        "overall_score", *lex.SCORE_FIELDS, F.col("toxicity_level").alias("level"),
        F.array_join("category", ", ").alias("categories"),
        F.array_join("toxicity_type", ", ").alias("types"), "explanation")
