"""Seeded text augmentation.

Draws come from ``md5(seed : row key : operator : position)`` (see ``draw_hex``), so a row's
result depends on nothing but the row: any partitioning and any task retry give the same text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentmill.functions.cut import materialized
from commentmill.functions.hot import join_keys
from commentmill.functions.numbers import draw_hex, draw_int, hex_threshold
from commentmill.functions.text import SPACES, WS, as_text, bind, is_blank, strip, tokens

AUGMENTED = "augmented_text"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Synonyms of a table that has at most this many words and bytes are sent to every task; beyond, words
#: and rows are joined by a shuffle.
SENT_WORDS, SENT_BYTES = 200_000, 16 << 20
ASCII_EDGES = r"\A[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\z"


@dataclass(frozen=True)
class AugmentConfig:
    """Which augmentations run, in this fixed order, and how strongly."""

    synonym_replacement: bool = False
    random_insertion: bool = False
    random_swap: bool = False
    random_deletion: bool = False
    back_translation: bool = False
    paraphrasing: bool = False
    sentence_shuffling: bool = False
    sentence_cropping: bool = False
    noise_injection: bool = False
    strength: float = 0.1


def clamp_strength(strength: float) -> float:
    return min(0.50, max(0.01, float(strength)))


def share_count(n: Column, share: float) -> Column:
    """max(1, floor(n * share))."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(float(share))).cast("int"))


def join_tokens(toks: Column) -> Column:
    return F.array_join(toks, " ")


def on_tokens(text: Column, least: int, edit) -> Column:
    """Edit the token array; text with fewer than ``least`` tokens is left as it is.

    ``text`` is bound once: a chain of such steps collapses into one expression, and a
    second reference would double the work at every step of the chain.
    """
    return bind(text, lambda t: bind(tokens(t), lambda toks: F.when(
        F.size(toks) < least, t).otherwise(join_tokens(edit(toks)))))


def _lowest(hashes: Column, k: Column) -> Column:
    """The k-th smallest hash of an array: a threshold that k positions pass."""
    return F.get(F.sort_array(hashes), k - 1)


# --- token operators -----------------------------------------------------------------


def _replace_positions(text: Column, key: Column, seed: int, op: str, share: float,
                       synonyms_at) -> Column:
    """Replace the tokens at the k positions with the lowest hashes, where they have synonyms.

    ``synonyms_at(token, position)`` gives the synonym array of a token, null if none.
    """

    def with_hashes(toks: Column) -> Column:
        hashes = F.transform(toks, lambda _, i: draw_hex(seed, key, op, i))
        return bind(hashes, lambda h: bind(
            _lowest(h, share_count(F.size(toks), share)), lambda top: swap_in(toks, h, top)))

    def swap_in(toks: Column, hashes: Column, top: Column) -> Column:
        def at(tok: Column, i: Column) -> Column:
            options = synonyms_at(F.regexp_replace(tok, ASCII_EDGES, ""))
            pick = F.get(options, draw_int(draw_hex(seed, key, op + ".pick", i),
                                           F.greatest(F.size(options), F.lit(1))).cast("int"))
            return F.when(F.get(hashes, i) <= top, F.coalesce(pick, tok)).otherwise(tok)

        return F.transform(toks, at)

    return on_tokens(text, 2, with_hashes)


Synonyms = Mapping[str, list[str]] | Column | Broadcast | None


def synonym_lookup(synonyms: Synonyms):
    """Token -> sorted array of other spellings, from a list, or from a map column of the row."""
    if isinstance(synonyms, Column):
        return lambda tok: F.try_element_at(synonyms, F.lower(tok))
    table = tidy_synonyms(synonyms or {})
    if not table:
        return lambda tok: F.lit(None).cast("array<string>")
    pairs = [x for w, s in table.items() for x in (F.lit(w), F.array(*map(F.lit, s)))]
    return lambda tok: F.when(F.lower(tok).isin(*table),
                              F.try_element_at(F.create_map(*pairs), F.lower(tok)))


def tidy_synonyms(synonyms: Mapping[str, list[str]]) -> dict[str, list[str]]:
    """Lower-case keys; synonyms ASCII, underscores as spaces, never the word itself."""
    out: dict[str, list[str]] = {}
    for word, options in synonyms.items():
        w = word.lower()
        named = {o.replace("_", " ") for o in options}
        keep = sorted(o for o in named if o.lower() != w and o.isascii())
        if keep:
            out[w] = sorted(set(out.get(w, [])) | set(keep))
    return out


def synonym_replacement(text: Column, key: Column, seed: int, share: float,
                        synonyms: Synonyms = None,
                        op: str = "synonym") -> Column:
    if isinstance(synonyms, Broadcast):
        return _token_udf(lambda t, k: replace_tokens(t, k, seed, share, op, _options(synonyms, k)), 2)(text, key)
    return _replace_positions(text, key, seed, op, share, synonym_lookup(synonyms))


def synonyms_from_table(df: DataFrame, text_col: str, synonyms: DataFrame, *, key: str,
                        seed: int = 42, share: float = 0.1,
                        output: str = AUGMENTED) -> DataFrame:
    """Synonym replacement from a (word, synonym) table of any size.

    Few words go to the rows (see ``sent_words``). Of more, only the k drawn tokens of a row travel: they
    are joined with the words (one row each, its options gathered) and the picks come back per row.
    Frequent words are joined apart (see ``join_keys``); ``key`` must be unique then. Rows without a key
    keep their words.
    """
    words = materialized(synonym_words(synonyms))
    sent = sent_words(words)
    if sent is not None:
        plain = df.withColumn("_text", as_text(F.col(text_col)))
        return plain.withColumn(output, synonym_replacement(F.col("_text"), F.col(key), seed, share, sent)).drop("_text")

    def drawn(toks: Column) -> Column:
        hashes = F.transform(toks, lambda _, i: draw_hex(seed, F.col(key), "synonym", i))
        return bind(hashes, lambda h: bind(
            _lowest(h, share_count(F.size(toks), share)), lambda top: F.filter(
                F.transform(toks, lambda t, i: F.when(F.get(h, i) <= top, F.struct(
                    i.alias("i"), F.lower(F.regexp_replace(t, ASCII_EDGES, "")).alias("word")))),
                lambda x: x.isNotNull())))

    base = df.withColumn("_toks", tokens(as_text(F.col(text_col))))
    long = base.filter(F.size("_toks") >= 2).select(
        F.col(key).alias("_k"), F.inline(bind(F.col("_toks"), drawn)))
    pick = F.get("options", draw_int(draw_hex(seed, F.col("_k"), "synonym.pick", F.col("i")),
                                     F.size("options")).cast("int"))
    picks = join_keys(long, words, "word").groupBy("_k").agg(
        F.map_from_entries(F.collect_list(F.struct("i", pick.alias("pick")))).alias("_picks"))
    joined = base.join(picks, F.col(key) == F.col("_k"), "left")
    new = F.transform("_toks", lambda t, i: F.coalesce(F.try_element_at("_picks", i), t))
    text = as_text(F.col(text_col))
    out = F.when(F.size("_toks") < 2, text).otherwise(join_tokens(
        F.when(F.col("_picks").isNull(), F.col("_toks")).otherwise(new)))
    return joined.withColumn(output, out).drop("_toks", "_k", "_picks")


def synonym_words(synonyms: DataFrame) -> DataFrame:
    """(word, options) from a (word, synonym) table, by the rules of ``tidy_synonyms``."""
    words = synonyms.select(F.lower("word").alias("word"),
                            F.translate("synonym", "_", " ").alias("s")).filter(
        (F.lower("s") != F.col("word")) & ~F.col("s").rlike(r"[^\x00-\x7f]"))
    return words.groupBy("word").agg(F.sort_array(F.collect_set("s")).alias("options"))


def sent_words(words: DataFrame) -> Broadcast | None:
    """word -> options for every task, if there are few."""
    size = F.octet_length("word") + F.aggregate("options", F.lit(0), lambda n, o: n + F.octet_length(o))
    lines, held = words.agg(F.count(F.lit(1)), F.sum(size)).first()
    if lines > SENT_WORDS or (held or 0) > SENT_BYTES:
        return None
    return words.sparkSession.sparkContext.broadcast({r["word"]: list(r["options"]) for r in words.collect()})


def _options(sent: Broadcast, key: str | None) -> Mapping[str, list[str]]:
    """Rows without a key meet no word of a table, sent or joined."""
    return {} if key is None else sent.value


def with_row_synonyms(df: DataFrame, text_col: str, words: DataFrame, key: str) -> DataFrame:
    """Adds ``_syn``: the options of every word of the row that has some. Only distinct words
    travel, not the texts' other tokens; ``key`` must be unique."""
    bare = F.transform(tokens(as_text(F.col(text_col))), lambda t: F.lower(F.regexp_replace(t, ASCII_EDGES, "")))
    used = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(bare)).alias("word"))
    found = join_keys(used, words, "word").groupBy("_k").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "options"))).alias("_syn"))
    return df.join(found, F.col(key) == F.col("_k"), "left").drop("_k")


def _draw(seed: int, key: str, op: str, pos: str, bound: int) -> int:
    """Python twin of ``draw_int(draw_hex(...))``."""
    digest = hashlib.md5(f"{seed}:{key}:{op}:{pos}".encode()).hexdigest()
    return int(digest[:8], 16) % bound


def replace_tokens(toks: list[str], key: str | None, seed: int, share: float, op: str,
                   synonyms: Mapping[str, list[str]]) -> list[str]:
    """Python twin of ``_replace_positions``. Only rows that hold a word with synonyms draw positions."""
    options = [synonyms.get(t.strip(PUNCTUATION).lower()) for t in toks]
    if not any(options):
        return toks
    hashes = _hex_draws(seed, key, op, len(toks))
    top = sorted(hashes)[max(1, int(len(toks) * share)) - 1]
    return [o[_draw(seed, key, op + ".pick", str(i), len(o))] if o and h <= top else t
            for i, (t, o, h) in enumerate(zip(toks, options, hashes, strict=True))]


def swap_tokens(toks: list[str], key: str, seed: int, share: float, op: str) -> list[str]:
    """k swaps of two distinct positions, one after the other."""
    n = len(toks)
    for j in range(max(1, int(n * share))):
        a = _draw(seed, key, op, f"{j}:a", n)
        b = _draw(seed, key, op, f"{j}:b", n - 1)
        b += b >= a
        toks[a], toks[b] = toks[b], toks[a]
    return toks


def insert_tokens(toks: list[str], key: str, seed: int, share: float,
                  synonyms: Mapping[str, list[str]]) -> list[str]:
    """k times: a token (or a synonym of it) goes into a random gap; the list grows."""
    for j in range(max(1, int(len(toks) * share))):
        base = toks[_draw(seed, key, "insert", f"{j}:base", len(toks))]
        options = synonyms.get(base.strip(PUNCTUATION).lower())
        new = options[_draw(seed, key, "insert", f"{j}:pick", len(options))] if options else base
        toks.insert(_draw(seed, key, "insert", f"{j}:gap", len(toks) + 1), new)
    return toks


#: Rows whose texts are Python objects at once.
SLICE_ROWS = 256


def _in_slices(one, *columns: pa.Array) -> pa.Array:
    """``one`` of the values of each row; only a slice of a batch is held as Python objects."""
    parts = [pa.array(map(one, *[c.slice(at, SLICE_ROWS).to_pylist() for c in columns]), pa.string())
             for at in range(0, len(columns[0]), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _token_udf(edit, least: int):
    """Apply a list edit to the tokens of each row, in Arrow batches.

    Swaps and insertions are sequences of dependent edits. As column expressions every
    edit copies the whole array (edits x tokens per row); a mutable list does it in place.
    """

    def one(text: str | None, key: str | None) -> str | None:
        toks = text.split() if text else []
        return " ".join(edit(toks, key)) if len(toks) >= least else text

    @F.arrow_udf(T.StringType())
    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        return _in_slices(one, text, key)

    # Spark cannot hand an expression with nested lambdas to Python. Neither the step before
    # nor this one may therefore be folded into another expression: the input is named twice,
    # and the function is declared non-deterministic (it is not: it only hashes its input).
    run = run.asNondeterministic()
    return lambda text, key: F.when(text == "", text).otherwise(run(text, key.cast("string")))


def random_swap(text: Column, key: Column, seed: int, share: float, op: str = "swap") -> Column:
    run = _token_udf(lambda t, k: swap_tokens(t, k, seed, share, op), 2)
    return run(text, key)


def random_insertion(text: Column, key: Column, seed: int, share: float,
                     synonyms: Synonyms = None) -> Column:
    if isinstance(synonyms, Column):
        def one(t: str, k: str, found: str | None) -> str:
            toks = t.split()
            options = json.loads(found) if found else {}
            return " ".join(insert_tokens(toks, k, seed, share, options)) if toks else t

        @F.arrow_udf(T.StringType())
        def run_map(t: pa.Array, k: pa.Array, found: pa.Array) -> pa.Array:
            return _in_slices(one, t, k, found)

        return F.when(text == "", text).otherwise(run_map.asNondeterministic()(
            text, key.cast("string"), F.to_json(synonyms)))
    if isinstance(synonyms, Broadcast):
        return _token_udf(lambda t, k: insert_tokens(t, k, seed, share, _options(synonyms, k)), 1)(text, key)
    table = tidy_synonyms(synonyms or {})
    run = _token_udf(lambda t, k: insert_tokens(t, k, seed, share, table), 1)
    return run(text, key)


def _hex_draws(seed: int, key: str | None, op: str, n: int) -> list[str]:
    """Python twin of ``draw_hex`` at the positions before ``n``; a missing key is left out."""
    start = f"{seed}:{op}:" if key is None else f"{seed}:{key}:{op}:"
    return [hashlib.md5(f"{start}{i}".encode()).hexdigest() for i in range(n)]


def delete_tokens(toks: list[str], key: str | None, seed: int, limit: str) -> list[str]:
    hashes = _hex_draws(seed, key, "delete", len(toks))
    return [t for t, h in zip(toks, hashes, strict=True) if h > limit] or [toks[hashes.index(max(hashes))]]


def random_deletion(text: Column, key: Column, seed: int, share: float) -> Column:
    """Drop each token with probability ``share``; if none is left, keep the luckiest one."""
    limit = hex_threshold(share)
    return _token_udf(lambda t, k: delete_tokens(t, k, seed, limit), 3)(text, key)


def back_translation(text: Column) -> Column:
    """Reverse the inner tokens; first and last stay."""

    def turn(toks: Column) -> Column:
        n = F.size(toks)
        return F.concat(F.slice(toks, 1, 1), F.reverse(F.slice(toks, F.lit(2), n - 2)),
                        F.slice(toks, n, F.lit(1)))

    return on_tokens(text, 4, turn)


def looks_up(step):
    """Marks a step that reads synonyms, so that a table's are brought to its input first."""
    step.looks_up = True
    return step


def paraphrase(key: Column, seed: int, synonyms: Synonyms = None) -> list:
    """Two steps: synonyms at 15 %, then swaps at 5 %."""
    return [
        looks_up(lambda text: synonym_replacement(text, key, seed, 0.15, synonyms, "paraphrase.synonym")),
        lambda text: random_swap(text, key, seed, 0.05, "paraphrase.swap"),
    ]


def sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), rf"(?<=[.!?]){WS}+"), lambda s: s != "")


def sentence_shuffle(text: Column, key: Column, seed: int) -> Column:
    def shuffled(sents: Column) -> Column:
        keyed = F.transform(sents, lambda s, i: F.struct(
            draw_hex(seed, key, "sentence", i).alias("h"), i.alias("i"), s.alias("s")))
        return F.array_join(F.transform(F.sort_array(keyed), lambda x: x["s"]), " ")

    return bind(text, lambda t: bind(
        sentences(t), lambda sents: F.when(F.size(sents) < 2, t).otherwise(shuffled(sents))))


def sentence_crop(text: Column, share: float) -> Column:
    """Drop the last ``max(1, floor(n * min(share, 0.4)))`` tokens."""
    return on_tokens(text, 5, lambda toks: F.slice(
        toks, F.lit(1), F.size(toks) - share_count(F.size(toks), min(share, 0.4))))


def noisy_text(text: str, key: str | None, seed: int, share: float) -> str:
    chars = list(text)
    n = max(1, int(len(chars) * share))
    places, letters = (_hex_draws(seed, key, op, n) for op in ("noise.at", "noise.letter"))
    put = {int(at[:8], 16) % len(chars): LETTERS[int(c[:8], 16) % 26] for at, c in zip(places, letters, strict=True)}
    for at, letter in put.items():  # the last draw of a place
        if chars[at] not in SPACES:
            chars[at] = letter
    return "".join(chars)


def noise_injection(text: Column, key: Column, seed: int, share: float) -> Column:
    """``max(1, floor(len * min(share, 0.08)))`` draws with replacement put a random letter at
    a random place; the last draw of a place wins and spaces stay. Only the drawn places are hashed."""
    def one(t: str | None, k: str | None) -> str | None:
        return noisy_text(t, k, seed, min(share, 0.08)) if t else t

    @F.arrow_udf(T.StringType())
    def run(t: pa.Array, k: pa.Array) -> pa.Array:
        return _in_slices(one, t, k)

    # named twice and not folded, as token edits are
    return F.when(text == "", text).otherwise(run.asNondeterministic()(text, key.cast("string")))


# --- the configured chain ------------------------------------------------------------


def augment_steps(key: Column, cfg: AugmentConfig, seed: int = 42,
                  synonyms: Synonyms = None) -> list:
    """The switched-on steps in their fixed order, each a Column -> Column function."""
    s = cfg.strength
    steps = []
    if cfg.synonym_replacement:
        steps.append(looks_up(lambda t: synonym_replacement(t, key, seed, s, synonyms)))
    if cfg.random_insertion:
        steps.append(looks_up(lambda t: random_insertion(t, key, seed, s, synonyms)))
    if cfg.random_swap:
        steps.append(lambda t: random_swap(t, key, seed, s))
    if cfg.random_deletion:
        steps.append(lambda t: random_deletion(t, key, seed, s))
    if cfg.back_translation:
        steps.append(back_translation)
    if cfg.paraphrasing:
        steps += paraphrase(key, seed, synonyms)
    if cfg.sentence_shuffling:
        steps.append(lambda t: sentence_shuffle(t, key, seed))
    if cfg.sentence_cropping:
        steps.append(lambda t: sentence_crop(t, s))
    if cfg.noise_injection:
        steps.append(lambda t: noise_injection(t, key, seed, s))
    return steps


def apply_steps(df: DataFrame, text_col: str, steps: list, output: str, *,
                words: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One projection per step, so that every step reads its input as a plain column. With
    ``words`` each look-up step finds its row's synonyms in the column ``_syn``."""
    out = df.withColumn("_raw", as_text(F.col(text_col))).withColumn("_text", F.col("_raw"))
    for step in steps:
        if words is not None and getattr(step, "looks_up", False):
            out = with_row_synonyms(out, "_text", words, key).withColumn("_text", step(F.col("_text"))).drop("_syn")
        else:
            out = out.withColumn("_text", step(F.col("_text")))
    raw = F.col("_raw")
    return out.withColumn(output, F.when(is_blank(raw), raw).otherwise(F.col("_text"))).drop(
        "_raw", "_text")


def augment(df: DataFrame, text_col: str, cfg: AugmentConfig, *, key: str, seed: int = 42,
            synonyms: Mapping[str, list[str]] | DataFrame | None = None,
            output: str = AUGMENTED) -> DataFrame:
    """Add the augmented text. Synonyms come from a list, or from a (word, synonym) table of any
    size (few words are sent to the rows, more are joined), with the same result. The source is ``processed_text`` where present; masked text
    derived from an older version is dropped. Blank text is unchanged."""
    source = "processed_text" if "processed_text" in df.columns else text_col
    words = None
    if isinstance(synonyms, DataFrame):
        words = materialized(synonym_words(synonyms))
        synonyms = sent_words(words)
        if synonyms is None:
            synonyms = F.col("_syn")
        else:
            words = None
    steps = augment_steps(F.col(key), cfg, seed, synonyms)
    return apply_steps(df, source, steps, output, words=words, key=key).drop("clean_text", "clean_replacements")
