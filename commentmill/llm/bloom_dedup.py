"""Exact duplicates by two passes over a Bloom filter of hashes seen more than once.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Pass one hashes
every text and counts the cells its hash touches; cells touched at least twice become the filter.
Pass two probes the filter: a hash with an untouched cell occurs once, and its row passes straight
through. Only the others shuffle, and are compared by their whole SHA-256.

Defined cases: of rows with one id and equal texts one stays where rows are dropped; a null id is smaller than any
other; an empty table gives an empty result; other columns are carried by ``drop_duplicates`` and
may have any name that does not begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import ascii_lower, attach, empty_if_null, materialized

#: Bits of the filter per row, and the most words of 64 bits it may have (2 million: some 50 MB
#: to broadcast). Beyond that it fills up: more rows shuffle, the result stays the same.
BITS_PER_ROW = 16
MAX_WORDS = 1 << 21


def text_hash(text: Column) -> Column:
    return F.sha2(ascii_lower(empty_if_null(text)), 256)


def _number(sha: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(sha, start, digits), 16, 10).cast("bigint")


def _word(sha: Column, words: int) -> Column:
    return F.pmod(_number(sha, 1, 15), F.lit(words))


def _cells(sha: Column) -> Column:
    """The two cells of a hash inside its word, equal ones once."""
    return F.array_distinct(F.array(*[F.pmod(_number(sha, at, 4), F.lit(64)).cast("int")
                                      for at in (17, 21)]))


def _mask(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("bigint"),
                       lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)))


def repeat_filter(hashes: DataFrame, words: int, sha: str = "__sha") -> DataFrame:
    """One line (__word, __bits) per word that has cells touched by two rows or more; at most
    ``words`` lines. Counts are combined before the shuffle, so copies cost one line per task."""
    touched = hashes.select(_word(F.col(sha), words).alias("__word"),
                            F.explode(_cells(F.col(sha))).alias("__cell"))
    twice = touched.groupBy("__word", "__cell").count().filter("count > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__cell"))
    return twice.groupBy("__word").agg(F.bit_or(bit).alias("__bits"))


def probe_listed(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with __maybe (its id may be listed, and is no null), and the listed ids. A Bloom filter
    of them is broadcast, its size bounded."""
    listed = materialized(ids.select(ids.columns[0]).toDF("__listed").filter("__listed IS NOT NULL").distinct())
    words = filter_words(listed.count())

    def digest(col: str) -> Column:
        return F.sha2(F.coalesce(F.col(col).cast("string"), F.lit("")), 256)

    coded = listed.select(digest("__listed").alias("__sha"))
    bloom = coded.groupBy(_word(F.col("__sha"), words).alias("__word")).agg(
        F.bit_or(_mask(_cells(F.col("__sha")))).alias("__bits"))
    probed = probe(df.withColumn("__sha", digest(id_col)), materialized(bloom), words)
    return probed.withColumn("__maybe", F.col("__maybe") & F.col(id_col).isNotNull()), listed


def drop_listed(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids`` (one column), null ids stay. Rows that the
    filter of listed ids does not know do not move."""
    probed, listed = probe_listed(df, ids, id_col)
    maybe = probed.filter("__maybe").select(*df.columns)
    return probed.filter(~F.col("__maybe")).select(*df.columns).unionByName(
        maybe.join(listed, F.col(id_col) == F.col("__listed"), "left_anti"))


def keep_listed(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (one column). Only rows that the filter of listed
    ids knows move."""
    probed, listed = probe_listed(df, ids, id_col)
    maybe = probed.filter("__maybe").select(*df.columns)
    return maybe.join(listed, F.col(id_col) == F.col("__listed"), "left_semi")


def filter_words(rows: int) -> int:
    words = 1024
    while words * 64 < rows * BITS_PER_ROW and words < MAX_WORDS:
        words *= 2
    return words


def probe(rows: DataFrame, bloom: DataFrame, words: int, sha: str = "__sha") -> DataFrame:
    """Adds __maybe: whether the hash may occur more than once."""
    mask = _mask(_cells(F.col(sha)))
    near = rows.withColumn("__word", _word(F.col(sha), words)).join(F.broadcast(bloom), "__word", "left")
    return (near.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False)))
            .drop("__word", "__bits"))


def _hashes(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int]:
    hashes = materialized(df.select(F.col(id_col).alias("__id"), text_hash(F.col(text_col)).alias("__sha")))
    total = hashes.count()
    words = filter_words(total)
    return hashes, materialized(repeat_filter(hashes, words)), words, total


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count("*").alias("__size"))


def find_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id (largest id of the equal texts), group_size, kept,
    text_sha256."""
    hashes, bloom, words, total = _hashes(df, id_col, text_col)
    probed = probe(hashes, bloom, words)
    alone = probed.filter(~F.col("__maybe")).select(
        "__id", "__sha", F.col("__id").alias("__keep"), F.lit(1).cast("bigint").alias("__size"))
    maybe = probed.filter("__maybe").select("__id", "__sha")
    groups = materialized(_groups(maybe))
    found = attach(maybe, groups, "__sha", "__size", total).select(*alone.columns)
    return alone.unionByName(found).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"), F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Rows whose hash cannot repeat do not
    move; the others meet their group's line by (hash, id), a key no group of copies makes hot. Rows
    equal in both are one before they move."""
    hashes, bloom, words, _ = _hashes(df, id_col, text_col)
    keep = _groups(probe(hashes, bloom, words).filter("__maybe")).select(
        F.col("__sha").alias("__k_sha"), F.col("__keep").alias("__k_id"))
    probed = probe(df.withColumn("__sha", text_hash(F.col(text_col))), bloom, words)
    alone = probed.filter(~F.col("__maybe")).select(*df.columns)
    same = (F.col("__sha") == F.col("__k_sha")) & F.col(id_col).eqNullSafe(F.col("__k_id"))
    maybe = probed.filter("__maybe").dropDuplicates(["__sha", id_col])
    return alone.unionByName(maybe.join(keep, same, "left_semi").select(*df.columns))
