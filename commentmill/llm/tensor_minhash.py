"""Near-duplicate groups by MinHash with tensored banding.

A text's set is its distinct shingles of words (A-Z lower-cased, split at ASCII white space); with
fewer words than a shingle has, the whole sequence is the one element. Two small collections of
``BUNDLES`` bundles of ``BUNDLE`` minima each are computed per distinct set; every pair of a bundle
of the first and one of the second is a table key. So BUNDLES**2 = 100 tables of 4 minima each cost
40 minima per set instead of 400. At similarity 0.8 a pair shares a key with probability 0.9999.

Rows meet at keys, never as all pairs: small buckets give their pairs, crowded ones connect their
members with leaders that differ from table to table. Every link is confirmed on full sets.
Links inside a component that is already connected need no confirmation, so verification runs in
rounds: one partner per set, then what is still apart, then further leaders. A crowded bucket whose
members are still in several components may hide a link that no leader shows; its members are
compared exactly, by shared rare shingles, with what is outside their own component, in blocks that
give only links (see ``_hidden_links``).

Defined cases: null text is empty; an empty set links with nothing; a null id links with nothing
and stays; an id may have several texts, each is a row of its own; where rows are dropped, of rows
that are equal in id and set one stays. Ids of any ordered type pass through; an empty table gives an
empty result. Columns of the input are only read by name and may be called anything else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.llm.bloom_dedup import drop_listed, filter_words, keep_listed
from commentmill.llm.common import attach, components, gathered, map_texts, materialized

BUNDLES, BUNDLE = 10, 2
#: Buckets up to this many sets give all their pairs: at most 15 per member.
SMALL_BUCKET = 16
WORDS_KEPT = 1 << 19
#: Further leaders a member meets before the exact comparison; each spares some of it.
OTHER_LEADERS = 8
#: Sets compared with one another in one call, on either side, and shingles they are compared by at once.
BLOCK_SETS, BLOCK_SHINGLES = 256, 8_192
#: Rounds of passing labels on before stragglers are dealt into blocks.
LABEL_ROUNDS = 2

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hash of a word, remembered; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = _mixed(total * _PRIME + h[i:i + n])
    return np.unique(total)


def _rule(seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    n = 2 * BUNDLES * BUNDLE
    return (draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            draw.integers(0, 1 << 63, n, dtype=np.uint64))


def bundles(shingles: np.ndarray, odd: np.ndarray, flip: np.ndarray) -> np.ndarray:
    """2 x BUNDLES numbers of 32 bits, each from BUNDLE minima."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        block = (shingles[at:at + 4096, None] ^ flip) * odd
        least = np.minimum(least, block.min(axis=0))
    groups = least.reshape(-1, BUNDLE)
    total = np.zeros(len(groups), np.uint64)
    for i in range(BUNDLE):
        total = _mixed(total * _PRIME + groups[:, i])
    return (total >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(width: int):
    def make():
        cache, (odd, flip) = _WordHashes(), _rule()

        def one(text: str | None) -> dict:
            s = shingle_set(text, width, cache)
            if not len(s):
                return {"n": 0, "set_key": None, "sig": None}
            return {"n": len(s), "set_key": _set_key(s), "sig": bundles(s, odd, flip)}
        return one
    return make


def _set_arrays(width: int):
    def make():
        cache = _WordHashes()

        def one(text: str | None) -> dict:
            found = shingle_set(text, width, cache)
            return {"set_key": _set_key(found), "shingles": found.view(np.int64)}
        return one
    return make


def _table_flip(table: Column) -> Column:
    """A number per table; ids flipped by it have another order in each table."""
    return F.xxhash64(table).bitwiseAND(F.lit((1 << 62) - 1))


def _keys(reps: DataFrame) -> DataFrame:
    """(key, table, rep): all BUNDLES**2 keys of each distinct set."""
    left, right = F.slice("sig", 1, BUNDLES), F.slice("sig", BUNDLES + 1, BUNDLES)
    return (reps.select("rep", F.posexplode(left).alias("i", "a"), right.alias("right"))
            .select("rep", "i", "a", F.posexplode("right").alias("j", "b"))
            .select((F.col("i") * BUNDLES + F.col("j")).alias("table"), "a", "b", "rep")
            .select(F.xxhash64("table", "a", "b").alias("key"), "rep",
                    _table_flip(F.col("table")).alias("flip")))


def _key_mask(key: Column) -> Column:
    """Two bits of a word, from the upper bits of a key."""
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, F.shiftrightunsigned(key, 58).cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, F.shiftrightunsigned(key, 52).bitwiseAND(F.lit(63)).cast("int")))


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b) that meet in a bucket, and (rep, at): the crowded ones of each set, at most
    one per table, with their leaders."""
    keys = _keys(reps)
    buckets = materialized(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    # most keys stand alone: a Bloom filter of the others, bounded in size, keeps them from moving
    words = filter_words(buckets.count())
    word, mask = F.pmod("key", F.lit(words)), _key_mask(F.col("key"))
    bloom = buckets.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits"))
    likely = (keys.withColumn("word", word).join(F.broadcast(bloom), "word")
              .filter(F.col("bits").bitwiseAND(mask) == mask).drop("word", "bits"))
    met = materialized(likely.join(buckets, "key"))
    small = (met.filter(F.col("c").between(2, SMALL_BUCKET)).groupBy("key")
             .agg(F.sort_array(F.collect_set("rep")).alias("reps")))
    near = (small.select("reps", F.explode("reps").alias("a"))
            .select("a", F.explode(F.filter("reps", lambda r: r > F.col("a"))).alias("b")))
    flipped, back = F.col("rep").bitwiseXOR(F.col("flip")), lambda c: F.col(c).bitwiseXOR(F.col("flip"))
    full = met.filter(F.col("c") > SMALL_BUCKET)
    leaders = (full.groupBy("key", "flip").agg(F.min(flipped).alias("lo"), F.max(flipped).alias("hi"))
               .select("key", F.array(back("lo"), back("hi")).alias("leads")))
    crowd = gathered(full.select("key", "rep").join(leaders, "key").groupBy("rep").agg(
        F.collect_list(F.struct("key", "leads")).alias("at")))
    # of all its buckets' leaders a set meets four at first
    led = F.filter(F.array_distinct(F.flatten("at.leads")), lambda x: x != F.col("rep"))
    few = crowd.select("rep", F.transform(led, lambda x: F.struct(
        F.xxhash64("rep", x).alias("drawn"), x.alias("lead"))).alias("led"))
    some = F.array(F.array_min("led.lead"), F.array_max("led.lead"), F.array_min("led")["lead"], F.array_max("led")["lead"])
    stars = (few.filter(F.size("led") > 0).select("rep", F.explode(F.array_distinct(some)).alias("lead"))
             .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")))
    return near.unionByName(stars).distinct(), crowd


def _tagged(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, rep, root, leads): the crowded buckets' members with their components. A set is given its
    root once, not in each of its buckets."""
    return (crowd.join(roots, crowd["rep"] == roots["node"], "left")
            .select("rep", F.coalesce("root", "rep").alias("root"), F.inline("at")))


def _other_leaders(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a member of a crowded bucket with a leader of it in another component."""
    tagged = _tagged(crowd, roots)
    leads = tagged.filter(F.array_contains("leads", F.col("rep"))).select(
        "key", F.col("rep").alias("lead"), F.col("root").alias("lead_root"))  # leaders are members too
    apart = tagged.select("key", "rep", "root").join(leads, "key").filter("root != lead_root")
    some = apart.groupBy("rep").agg(*[F.min_by("lead", F.xxhash64("lead", "rep", F.lit(i))).alias(f"m{i}")
                                      for i in range(OTHER_LEADERS)])
    met = some.select("rep", F.explode(F.array_distinct(F.array(*[f"m{i}" for i in range(OTHER_LEADERS)]))).alias("lead"))
    return met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity, and in how many places their bundles agree."""
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(reps.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"),
                                       F.col("n").alias(f"n_{side}")), side)
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")),
                       F.lit(0), lambda x, y: x + y)
    return (sides.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .select("a", "b", "n_a", "n_b", same.alias("same")))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) linked on full sets."""
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t")), "b"))
    shared = F.size(F.array_intersect("s", "t"))
    return (both.select("a", "b", shared.alias("shared"),
                        (F.size("s") + F.size("t") - shared).alias("joined"))
            .filter(100 * F.col("shared") >= percent * F.col("joined")).select("a", "b"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    out = pairs
    for side in ("a", "b"):
        root = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        out = out.join(root, side, "left")
    return (out.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
            .drop("root_a", "root_b"))


def _linked_blocks(percent: int):
    """Compares the sets of two blocks, all at once by their common shingles, and gives links that
    connect different roots: at most one less than the roots of both blocks."""
    def compare(xs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(xs) and len(held):
            shared = _shared(xs["own"].tolist(), held["shingles"].tolist())
            sizes = xs["own"].map(len).to_numpy()[:, None] + held["shingles"].map(len).to_numpy()[None, :]
            linked = 100 * shared >= percent * (sizes - shared)
            linked &= xs["x_root"].to_numpy()[:, None] != held["root"].to_numpy()[None, :]
            up: dict[int, int] = {}

            def root(r: int) -> int:
                while up.get(r, r) != r:
                    r = up[r]
                return r

            x, x_root, rep, rep_root = (c.tolist() for c in (xs["x"], xs["x_root"], held["rep"], held["root"]))
            for i, j in np.argwhere(linked).tolist():
                p, q = root(x_root[i]), root(rep_root[j])
                if p != q:
                    up[p] = q
                    found.append((min(x[i], rep[j]), max(x[i], rep[j])))
        return pd.DataFrame(found, columns=["a", "b"])
    return compare


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets has in common."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))))
    common = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        here = common[at] == values if len(common) else np.zeros(len(values), bool)
        places.append((at[here], rows[here]))
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), BLOCK_SHINGLES):
        width = min(BLOCK_SHINGLES, len(common) - lo)
        marks = []
        for (at, rows), sets in zip(places, (left, right), strict=True):
            here = (at >= lo) & (at < lo + width)
            m = np.zeros((len(sets), width), np.float32)
            m[rows[here], at[here] - lo] = 1
            marks.append(m)
        total += marks[0] @ marks[1].T
    return np.rint(total).astype(np.int64)


def _hidden_links(crowd: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of crowded buckets, found exactly.

    Sets that similar share one of their rarest shingles, counted among these sets, if each keeps
    n - ceil(percent/100 * n) + 1 of them; shingles that no other of these sets has bound what two
    sets can share at most. A set asks each large component with which it shares a rare shingle, once.
    Sets of small components meet at the shingle: as pairs where few hold it. All others are dealt
    into blocks, and only links leave the task."""
    tagged = _tagged(crowd, roots).select("key", "rep", "root")
    mixed = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    members = tagged.join(mixed, "key", "left_semi").select("rep", "root").distinct()
    held = gathered(members.join(sets, "rep").select("rep", "root", F.size("shingles").alias("n"), "shingles"))
    total = held.agg(F.sum("n")).first()[0]
    if not total:  # no crowded bucket spans several components
        return held.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    posted = held.select("rep", "root", "n", F.explode("shingles").alias("s"))
    seen = gathered(posted.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"))
    counted = attach(posted, seen, "s", "c", total)  # shingles that several have, with their number
    ranked = counted.groupBy("rep", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
    # of the rarest, those that one set only has come first
    most = F.size("all")
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - most)
    rare = gathered(ranked.filter(100 * most >= percent * F.col("n"))
                    .select("rep", "root", "n", most.alias("most"),
                            F.explode(F.slice("all", F.lit(1), F.greatest(kept, F.lit(0)))).alias("e"))
                    .select("rep", "root", "n", "most", "e.s"))
    sizes = gathered(held.groupBy("root").agg(F.count("*").alias("members")))
    rare = gathered(rare.join(sizes, "root").withColumn("large", F.col("members") > SMALL_BUCKET).drop("members"))
    to_large = gathered(_asks_of_large(rare, percent).distinct())
    small = rare.filter("NOT large").drop("large")
    who = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"who{i}") for i in range(2)]
    shared = small.groupBy("s").agg(F.count("*").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"), *who)
    # shingles that the same sets hold ask the same: one of them is enough
    of_small = gathered(shared.filter("lo < hi").groupBy("held", "who0", "who1").agg(F.min("s").alias("s")).select("s", "held"))
    near = gathered(small.join(of_small, "s"))
    few = F.col("held") <= SMALL_BUCKET
    asking = near.filter(few).select("s", F.col("rep").alias("x"), F.col("root").alias("x_root"),
                                     F.col("n").alias("x_n"), F.col("most").alias("x_most"))
    pairs = (asking.join(near.filter(few).select(F.col("s").alias("s"), "rep", "root", "n", "most"), "s")
             .filter((F.col("x") < F.col("rep")) & (F.col("x_root") != F.col("root"))
                     & (100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n"))
                     & ((100 + percent) * F.least("most", "x_most") >= percent * (F.col("n") + F.col("x_n"))))
             .select(F.col("x").alias("a"), F.col("rep").alias("b")).distinct())
    # (group, x) asks all of (group, rep): a large root by its askers, a block of sets by another block
    near_asks, near_holds = _block_pairs(gathered(near.filter(~few).select("s", "rep", "root")))
    asks = gathered(to_large.select(F.concat(F.lit("r"), "to").alias("group"), F.col("rep").alias("x"), F.col("root").alias("x_root"))
                    .unionByName(near_asks))
    mine = held.select(F.concat(F.lit("r"), "root").alias("group"), "rep", "root")
    holds = mine.join(asks.select("group").distinct(), "group", "left_semi").unionByName(near_holds)
    linked = gathered(_between_blocks(asks, holds, held, percent))
    return _confirmed(gathered(pairs), sets, percent).unionByName(linked).distinct()


def _block_pairs(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, x, x_root) and (group, rep, root): blocks of sets that have a shingle in common. Sets
    share most shingles with the same others, so blocks are cut from what a few rounds of passing the
    smallest number on have brought together; a set then goes to few blocks, not to one per shingle."""
    sets = gathered(many.select("rep", "root").distinct())
    labels = sets.select("rep", F.col("rep").alias("label"))
    for _ in range(LABEL_ROUNDS):
        least = many.join(labels, "rep").groupBy("s").agg(F.min("label").alias("label"))
        labels = gathered(many.select("s", "rep").join(least, "s").groupBy("rep").agg(F.min("label").alias("label")))
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    blocks = gathered(labels.join(sizes, "label").select("rep", F.xxhash64("label", part).alias("b")).join(sets, "rep"))
    at = gathered(many.select("s", "rep").join(blocks.select("rep", "b"), "rep").select("s", "b").distinct())
    pairs = gathered(at.join(at.select(F.col("s").alias("s"), F.col("b").alias("c")), "s").filter("b <= c")
                     .select("b", "c", F.concat_ws(":", "b", "c").alias("group")).distinct())
    asks = pairs.select("group", "b").join(blocks, "b").select("group", F.col("rep").alias("x"), F.col("root").alias("x_root"))
    holds = pairs.select("group", F.col("c").alias("b")).join(blocks, "b").select("group", "rep", "root")
    return asks, holds


def _asks_of_large(rare: DataFrame, percent: int) -> DataFrame:
    """(rep, root, to): sets that share a rare shingle with members of a large root, and whose sizes
    allow a link. The commonest large root of a shingle does not ask the others that have it."""
    large = rare.filter("large").groupBy("s", "root").agg(
        F.count("*").alias("c"), F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), F.max("most").alias("hi_most"))
    main = large.groupBy("s").agg(F.max(F.struct("c", "root")).alias("m")).select("s", F.col("m.root").alias("main"))
    targets = large.withColumnRenamed("root", "to").join(main, "s")
    return (rare.join(targets, "s")
            .filter((F.col("root") != F.col("to")) & (~F.col("large") | (F.col("root") != F.col("main")))
                    & (percent * F.col("n") <= 100 * F.col("hi_n")) & (percent * F.col("lo_n") <= 100 * F.col("n"))
                    & ((100 + percent) * F.least("hi_most", "most") >= percent * (F.col("lo_n") + F.col("n"))))
            .select("rep", "root", "to"))


def _between_blocks(asks: DataFrame, holds: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links between the sets that ask (group, x, x_root) and those that a group holds (group, rep,
    root). Both are dealt into blocks, so a set goes once to each block of the other side."""
    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK_SETS).cast("int")

    def block(of: str, n: str) -> Column:
        return F.pmod(F.xxhash64(of), blocks(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks(n) - 1))

    counts = gathered(asks.groupBy("group").agg(F.count("*").alias("ask"))
                      .join(holds.groupBy("group").agg(F.count("*").alias("held")), "group"))
    own = held.select("rep", "shingles")
    left = (asks.join(counts, "group").select("group", "x", "x_root", block("x", "ask").alias("u"), every("held").alias("v"))
            .join(own.toDF("x", "own"), "x"))
    right = (holds.join(counts, "group").select("group", "rep", "root", block("rep", "held").alias("v"), every("ask").alias("u"))
             .join(own.toDF("rep", "shingles"), "rep"))
    key = ["group", "u", "v"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_linked_blocks(percent), "a bigint, b bigint")


def _found(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per row of ``df``: id, mark (a hash of its text), n, component (smallest id and mark
    reachable; of an empty set or a null id, its own)."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "id", F.struct("id", F.xxhash64("text").alias("mark")))
    sketches = materialized(map_texts(
        texts, "id", "text", _sketch(width), "s", "struct<n:bigint,set_key:binary,sig:array<int>>").select("id", "s.*"))
    sized = sketches.filter("n > 0 AND id.id IS NOT NULL")
    # the number of a set is given once, in what is written
    groups = materialized(sized.groupBy("set_key").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"),
        F.first("sig").alias("sig")).withColumn("rep", F.monotonically_increasing_id()))
    reps = groups.select("rep", "n", "sig")
    found, crowd = _candidates(reps)
    pairs = gathered(_agreeing(found, reps, percent))
    wanted = (pairs.select(F.explode(F.array("a", "b")).alias("rep"))
              .unionByName(crowd.select("rep")).distinct())
    named = groups.join(wanted, "rep", "left_semi").select("least.id")
    chosen = keep_listed(texts.select("id.id", "text"), named, "id")
    sets = map_texts(chosen, "id", "text", _set_arrays(width), "s", "struct<set_key:binary,shingles:array<bigint>>")
    sets = gathered(sets.select("s.*").dropDuplicates(["set_key"]).join(groups.select("set_key", "rep"), "set_key")
                    .select("rep", "shingles"))
    # one partner each first: most of a group is connected by these few confirmations
    ends = pairs.select(F.col("b").alias("x"), "a", "b", "same").unionByName(
        pairs.select(F.col("a").alias("x"), "a", "b", "same"))
    best = ends.groupBy("x").agg(F.max(F.struct("same", -F.col("a"), "b")).alias("m"))
    first = best.select((-F.col("m.col2")).alias("a"), F.col("m.b").alias("b")).distinct()
    links = gathered(_confirmed(first, sets, percent))
    roots = components(links)
    rest = _apart(pairs.select("a", "b"), roots).join(first, ["a", "b"], "left_anti")
    links = gathered(links.unionByName(_confirmed(rest, sets, percent)))
    roots = components(links)
    more = _agreeing(_other_leaders(crowd, roots), reps, percent).select("a", "b")
    links = gathered(links.unionByName(_confirmed(more, sets, percent)))
    roots = components(links)
    hidden = gathered(_hidden_links(crowd, roots, sets, percent))
    roots = components(links.unionByName(hidden))
    linked = materialized(groups.select("rep", "least").join(roots, F.col("rep") == F.col("node")))
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    known = linked.select("rep", "root").join(least, "root").select("rep", "component")
    facts = groups.join(known, "rep", "left").select(
        "set_key", "copies", F.coalesce("component", "least").alias("component"))
    inside = attach(sized.select("id", "n", "set_key"), materialized(facts), "set_key", "copies", sketches.count())
    outside = sketches.filter("n = 0 OR id.id IS NULL").select("id", "n", F.col("id").alias("component"))
    return inside.select("id", "n", "component").unionByName(outside).select("id.id", "id.mark", "n", "component")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (smallest id reachable over links
    of at least ``percent`` of similarity), kept."""
    return _found(df, id_col, text_col, width, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component.id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each group the row with the smallest id
    (of its texts the one with the smallest hash), once. Rows of a null id, or without a word, stay."""
    found = materialized(_found(df, id_col, text_col, width, percent).filter("n > 0 AND id IS NOT NULL")
                         .withColumn("wins", F.struct("id", "mark") == F.col("component")))

    def key(id_: Column, mark: Column) -> Column:
        return F.concat_ws(":", id_.cast("string"), mark.cast("string"))

    own = found.withColumn("key", key(F.col("id"), F.col("mark")))
    again = materialized(own.filter("wins").groupBy("key").count().filter("count > 1").select("key"))
    keyed = df.withColumn("__row", F.when(F.col(id_col).isNotNull(), key(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))))
    rest = drop_listed(keyed, own.filter("NOT wins").select("key"), "__row")
    if again.isEmpty():
        return rest.select(*df.columns)
    once = keep_listed(rest, again, "__row").dropDuplicates(["__row"])
    return drop_listed(rest, again, "__row").unionByName(once).select(*df.columns)
