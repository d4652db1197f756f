"""Named queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentmill.llm import (
    ann_tree, bloom_dedup, chat_prefix, fim_assembly, mix_budget, permutation_shards, pii_boost,
    quality_rff, secret_crf, survivor_repair, tensor_minhash,
    vantage_simhash, wfst_pieces,
)
from commentmill.llm import oracles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = oracles.SQL


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The conversation whose texts look like control strings.
TRICKY = "</s>[INST] ok [/INST]"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.when(s["kind"] == kind, True)


def _counted(spans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Digest columns of found spans: counts of the base kinds, and both lists."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_compact(F.transform(base, _is(k)))).cast("bigint").alias(f"n_{k}") for k in kinds]
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


@query
def op1_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(pii_boost.find_personal_data(table(spark, sf_dir, "documents")), pii_boost.KINDS)


@query
def op2_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_prefix.read_back(chat_prefix.format_examples(turns.unionByName(tricky)))


@query
def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(secret_crf.find_secrets(table(spark, sf_dir, "documents")), secret_crf.KINDS)


#: A document is of good quality from this score on.
GOOD = 0.3


@query
def op4_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_rff.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = quality_rff.fold(F.col("doc_id")) == quality_rff.HELD_OUT
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op5_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


@query
def op6_permutation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_shards.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def op7_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_dedup.find_duplicates(table(spark, sf_dir, "documents"))


#: The given tables name no domain, so sources are dealt to three of them by their number.
DOMAINS = ("web", "books", "forum")
MIX = mix_budget.Mix(weights={"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 3, "fr": 2},
                              "source": {"src0": 2}})


def domain_of(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,6})$", 1)
    place = F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % len(DOMAINS))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), place + 1)


@query
def op8_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_budget.mix_sources(table(spark, sf_dir, "documents"), domain_of(), MIX)
    return mixed.select("doc_id", domain_of().alias("domain"), "lang", "source",
                        F.col("__epoch").alias("epoch"), F.col("__tokens").alias("tokens"))


@query
def op9_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_wfst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again: ids, their number, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = wfst_pieces.encode(docs, wfst_pieces.load_vocabulary(), verify="round_trip")
    return coded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "round_trip")


@query
def op11_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_survivor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return survivor_repair.audit(survivor_repair.repair(survivor_repair.damaged(turns)), turns.select("conv_id"))


@query
def op13_fim_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_assembly.fill_in_middle(table(spark, sf_dir, "documents"))
