"""Named queries over the given tables. Texts that the tables lack (links, mentions, slang,
disguised words, scorer answers) are derived from whole documents, row by row."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.functions.cut import ensure_checkpoint_dir
from commentmill.functions.text import bind, tokens
from commentmill.operators import (
    augment, clean, features, lexicon_table, metrics, model, parse, profanity, profile, rows, stats,
)
from commentmill.operators.knn import KNNClassifier
from commentmill.plans import scoring
from commentmill.plans.lexicon_scorer import lexicon_scorer, python_scorer
from commentmill.sources import datasets, history

# The words that mark toxic documents in the given tables.
TERMS = ["trash", "scum", "idiot", "clown", "worthless", "moron", "pathetic", "loser", "stupid",
         "disgusting"]
SYNONYMS = {"the": ["that", "this"], "and": ["plus"], "de": ["du", "des"], "la": ["une"],
            "der": ["die"], "is": ["was"]}
PHRASES = {"trash": "poor work", "idiot": "person", "stupid": "unwise"}
SEED = 42

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *cols)


def _one(name: str, step: Callable[[Column], Column], cols: str = "text") -> None:
    """Register a query that applies one text step to every document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", step(F.col(cols)).alias("out"))

    run.__name__ = name
    query(run)


def social(text: Column, key: Column) -> Column:
    """The document as a social-media post."""
    k = key.cast("string")
    return F.concat(F.lit("rt : @user"), k, F.lit(" \u201c\u201dsee\u200b https://ex.org/p"), k,
                    F.lit(" or WWW.ex.org mail bob.x"), k,
                    F.lit("@mail.example.com now #topic ##deep what?!?! <b>so</b> "), text)


def chatty(text: Column) -> Column:
    """The document with slang and contractions for some of its frequent words."""
    out = text
    for word, short in (("the", "u"), ("and", "can't"), ("of", "GONNA"), ("de", "idk"),
                        ("la", "(isn't)"), ("der", "b/c"), ("is", "y'all")):
        out = F.regexp_replace(out, f" {word} ", f" {short} ")
    return out


def disguised(text: Column) -> Column:
    """The document with separated, look-alike and inflected forms of two terms."""
    return F.concat(F.lit("S.t-u p*i_d m0r0n "), text, F.lit(" loser's idiots (t r a s h) $cum"))


# --- cleaning ----------------------------------------------------------------------------

_one("clean_invisible_and_fences", lambda t: clean.collapse_quote_fences(
    clean.strip_invisible(F.concat(F.lit('\u00ab\u00bb"a\u200bb\ufeff '), t))))
_one("clean_elongations", clean.reduce_elongations)
_one("clean_lowercase", clean.lowercase)
_one("clean_punctuation", clean.remove_punctuation)
_one("clean_numbers", clean.remove_numbers)
_one("clean_stopwords", clean.remove_stopwords)
_one("clean_whitespace", clean.normalize_whitespace)
_one("clean_blank_to_empty", lambda t: clean.blank_to_empty(clean.remove_punctuation(
    F.regexp_replace(t, "[A-Za-z]", ""))))
_one("clean_unicode", lambda t: clean.normalize_unicode(F.translate(
    t, "0123456789", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19")))
_one("clean_token_phrases", lambda t: clean.map_tokens(
    chatty(t), {**lex.SLANG, **lex.CONTRACTIONS}))


@query
def clean_phrase_table(spark, sf_dir):
    """Every word of four or more characters of the documents has a phrase, which tells its length."""
    d = documents(spark, sf_dir)
    words = d.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct()
    table = words.filter(F.length("token") >= 4).withColumn(
        "phrase", F.concat(F.lit("<"), F.col("token"), F.lit(" "), F.length("token").cast("string"), F.lit(">")))
    return clean.map_tokens_table(d, "text", table).select("doc_id", F.md5("processed_text").alias("processed_text"))


@query
def clean_noise_steps(spark, sf_dir):
    d = documents(spark, sf_dir)
    steps = {s.__name__: s(social(F.col("text"), F.col("doc_id"))) for s in clean.NOISE_STEPS}
    return d.select("doc_id", *[F.md5(c).alias(n) for n, c in steps.items()])


@query
def clean_noise(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", clean.remove_noise(social(F.col("text"), F.col("doc_id"))).alias("out"))


@query
def clean_page_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", clean.strip_urls(clean.strip_tags(
        F.concat_ws(" ", "url", "html"))).alias("out"))


@query
def clean_configured(spark, sf_dir):
    cfg = clean.CleanConfig(**dict.fromkeys(clean.CleanConfig.names(), True))
    posts = documents(spark, sf_dir).withColumn("text", social(F.col("text"), F.col("doc_id")))
    return clean.clean(posts, "text", cfg).select("doc_id", "processed_text")


# --- statistics --------------------------------------------------------------------------


@query
def text_statistics(spark, sf_dir):
    s = stats.text_statistics(documents(spark, sf_dir), "text")
    return s.select("n_rows", *[F.round(c, 8).alias(c) for c in stats.STATISTICS])


@query
def suggested_steps(spark, sf_dir):
    s = stats.suggest_cleaning(documents(spark, sf_dir), "text")
    return s.select(*clean.CleanConfig.names())


@query
def post_statistics_by_source(spark, sf_dir):
    d = documents(spark, sf_dir, "source").withColumn(
        "text", social(F.col("text"), F.col("doc_id")))
    m = stats.measure_rows(d, "text")
    return m.groupBy("source").agg(*[F.count_if(f).alias(f) for f in sorted(
        stats.ROW_FLAGS.values())])


# --- profanity ---------------------------------------------------------------------------


@query
def scan_documents(spark, sf_dir):
    s = profanity.scan(documents(spark, sf_dir), "text", TERMS)
    return s.select("doc_id", "has_profanity", "profanity_count",
                    F.array_join("profanity_matches", ", ").alias("profanity_matches"))


@query
def scan_disguised(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text", disguised(F.col("text")))
    s = profanity.scan(d, "text", TERMS)
    return s.select("doc_id", "profanity_count",
                    F.array_join("profanity_matches", ", ").alias("profanity_matches"))


@query
def undisguised_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", profanity.undisguise(
        disguised(F.col("text"))).alias("out"))


@query
def scan_conversations_by_role(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("role", "text")
    return profanity.flagged_share(profanity.scan(c, "text", ["the", "de", "der"]), "role")


@query
def flagged_share_by_language(spark, sf_dir):
    cfg = clean.CleanConfig(remove_punctuation=True, remove_numbers=True,
                            normalize_whitespace=True)
    cleaned = clean.clean(documents(spark, sf_dir, "lang"), "text", cfg)
    share = profanity.flagged_share(profanity.scan(cleaned, clean.PROCESSED, TERMS), "lang")
    return share.withColumn("percent", F.round("percent", 6))


def _sanitized(spark, sf_dir, **options) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("text", disguised(F.col("text")))
    return profanity.sanitize(d, "text", TERMS, **options).select(
        "doc_id", "clean_text", F.array_join("clean_replacements", ", ").alias("clean_replacements"))


@query
def mask_profanity(spark, sf_dir):
    return _sanitized(spark, sf_dir)


@query
def replace_profanity(spark, sf_dir):
    return _sanitized(spark, sf_dir, mode="replace", replacement_map=PHRASES)


def _large_lexicon(d: DataFrame) -> DataFrame:
    """Every word of eight letters, and 100 terms for each document that no text has."""
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    other = d.select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("k"), "doc_id").select(
        F.concat(F.lit("zq"), F.left(F.md5(F.concat_ws(":", "doc_id", "k")), F.lit(10))).alias("term"))
    return words.filter(F.length("term") == 8).unionByName(other).distinct()


def _spaced_words(text: Column) -> Column:
    """The words of a text with figures between them; every third word is spelt, if of eight letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w, i: F.when(
        (i % 3 == 0) & (F.length(w) == 8), F.array_join(F.split(w, ""), ".")).otherwise(w)), " 0 ")


@query
def scan_large_lexicon(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = lexicon_table.scan_table(d, "text", _large_lexicon(d))
    return s.select("doc_id", "profanity_count", F.md5(F.array_join("profanity_matches", ",")).alias("matches"))


@query
def sanitize_large_lexicon(spark, sf_dir):
    d = documents(spark, sf_dir)
    spaced = d.select("doc_id", _spaced_words(F.coalesce("text", F.lit(""))).alias("text"))
    s = lexicon_table.sanitize_table(spaced, "text", _large_lexicon(d))
    return s.select("doc_id", F.md5("clean_text").alias("clean_text"),
                    F.md5(F.array_join("clean_replacements", ",")).alias("replacements"))


@query
def changed_row_count(spark, sf_dir):
    return profanity.changed_rows(profanity.sanitize(documents(spark, sf_dir), "text", TERMS))


# --- augmentation ------------------------------------------------------------------------

_KEY = "doc_id"


def _augmented(name: str, step: Callable[[Column, Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = augment.apply_steps(documents(spark, sf_dir), "text",
                                [lambda t: step(t, F.col(_KEY))], "out")
        return d.select(_KEY, "out")

    run.__name__ = name
    query(run)


_one("augment_tokenize_join", lambda t: augment.join_tokens(tokens(t)))
_augmented("augment_synonyms", lambda t, k: augment.synonym_replacement(t, k, SEED, 0.1, SYNONYMS))
_augmented("augment_insertion", lambda t, k: augment.random_insertion(t, k, SEED, 0.1, SYNONYMS))
_augmented("augment_swap", lambda t, k: augment.random_swap(t, k, SEED, 0.1))
_augmented("augment_deletion", lambda t, k: augment.random_deletion(t, k, SEED, 0.1))
_augmented("augment_back_translation", lambda t, k: augment.back_translation(t))
_augmented("augment_sentence_shuffle", lambda t, k: augment.sentence_shuffle(t, k, SEED))
_augmented("augment_sentence_crop", lambda t, k: augment.sentence_crop(t, 0.1))
_augmented("augment_noise", lambda t, k: augment.noise_injection(t, k, SEED, 0.1))


@query
def augment_paraphrase(spark, sf_dir):
    cfg = augment.AugmentConfig(paraphrasing=True)
    return augment.augment(documents(spark, sf_dir), "text", cfg, key=_KEY, seed=SEED,
                           synonyms=SYNONYMS).select(_KEY, "augmented_text")


def _synonym_table(spark) -> DataFrame:
    return spark.createDataFrame([(w, o) for w, s in SYNONYMS.items() for o in s], "word string, synonym string")


@query
def augment_insertion_table(spark, sf_dir):
    cfg = augment.AugmentConfig(random_insertion=True)
    return augment.augment(documents(spark, sf_dir), "text", cfg, key=_KEY, seed=SEED,
                           synonyms=_synonym_table(spark)).select(_KEY, "augmented_text")


@query
def augment_paraphrase_table(spark, sf_dir):
    cfg = augment.AugmentConfig(paraphrasing=True)
    return augment.augment(documents(spark, sf_dir), "text", cfg, key=_KEY, seed=SEED,
                           synonyms=_synonym_table(spark)).select(_KEY, "augmented_text")


@query
def augment_synonym_table(spark, sf_dir):
    """Synonyms from a table: nations as (name, region) pairs put into the documents."""
    n = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    synonyms = n.select(F.lower("n_name").alias("word"), F.lower("r_name").alias("synonym"))
    place = F.concat(F.lit("nation_"), F.pmod("doc_id", F.lit(25)).cast("string"))
    d = documents(spark, sf_dir).withColumn("text", F.concat_ws(" ", place, "text", place))
    return augment.synonyms_from_table(d, "text", synonyms, key=_KEY, seed=SEED, share=0.5).select(
        _KEY, F.col(augment.AUGMENTED).alias("out"))


@query
def augment_configured(spark, sf_dir):
    cfg = augment.AugmentConfig(True, True, True, True, True, True, True, True, True)
    return augment.augment(documents(spark, sf_dir), "text", cfg, key=_KEY, seed=SEED,
                           synonyms=SYNONYMS).select(_KEY, "augmented_text")


# --- profiles, projections, edits ----------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    p = profile.profile_columns(table(spark, sf_dir, "documents"))
    return p.withColumn("mean_length", F.round("mean_length", 6))


@query
def column_profile_orders(spark, sf_dir):
    p = profile.profile_columns(table(spark, sf_dir, "orders"))
    return p.withColumn("mean_length", F.round("mean_length", 6))


@query
def training_pair_verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pairs = [("text", "toxic"), ("text", "text"), ("text", "doc_id"), ("text", "lang")]
    lines = [(t, y, profile.validate_training_pair(d, t, y)[0]) for t, y in pairs]
    return spark.createDataFrame(lines, "text_col string, label_col string, ok boolean")


@query
def blank_row_counts(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text", F.when(
        F.col("doc_id") % 9 == 0, F.lit(" \u3000\t\n")).when(
        F.col("doc_id") % 9 == 1, F.lit(None)).otherwise(F.col("text")))
    return rows.blank_counts(d, "text")


@query
def truncated_texts(spark, sf_dir):
    d = rows.truncate_text(documents(spark, sf_dir), "text")
    return d.select("doc_id", "text_cut", "was_cut")


@query
def text_previews(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rows.preview(F.col("text")).alias("p180"),
                                           rows.preview(F.col("text"), 500, tabs=False).alias("p500"))


@query
def preview_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("row_id", F.col("doc_id") + 1)
    return rows.preview_page(d, "text", 1, size=150)


@query
def page_counts(spark, sf_dir):
    return rows.page_count(table(spark, sf_dir, "documents"))


@query
def edited_rows(spark, sf_dir):
    base = documents(spark, sf_dir, "lang").withColumn("row_id", F.col("doc_id") + 1)
    edits = table(spark, sf_dir, "labels").filter("quality = 0").select(
        (F.col("doc_id") + 1).alias("row_id"), F.lit("edited").alias("text"),
        F.lit("xx").alias("lang"))
    return rows.apply_edits(base, edits, row_id="row_id", text_col="text", label_col="lang",
                            edited_page=0, size=100).select("row_id", "text", "lang")


@query
def sampled_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return rows.sample_rows(d, 100, key="doc_id", seed=SEED)


@query
def sampled_rows_large(spark, sf_dir):
    return rows.sample_rows(table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).distinct(), 12_000, key="k")


# --- files -----------------------------------------------------------------------------------


def _written(spark, write: Callable[[str], None]) -> str:
    """Writes into a new folder of the session's shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}"
    write(path)
    return path


@query
def csv_round_trip(spark, sf_dir):
    """Documents exported and read again; texts hold quotes and line breaks."""
    path = _written(spark, lambda p: datasets.export_csv(documents(spark, sf_dir, "lang"), p))
    return datasets.load_dataset(spark, path, "csv", "doc_id bigint, text string, lang string",
                                 multiline=True, strict=True)


@query
def json_round_trip(spark, sf_dir):
    path = _written(spark, lambda p: documents(spark, sf_dir, "lang").write.json(p))
    return datasets.load_dataset(spark, path, "jsonl", "doc_id bigint, text string, lang string", strict=True)


@query
def text_lines(spark, sf_dir):
    """Every line of the documents as one comment, counted."""
    path = _written(spark, lambda p: documents(spark, sf_dir).select("text").write.text(p))
    return datasets.load_dataset(spark, path, "text").groupBy("comment_text").agg(F.count("*").alias("n"))


@query
def dispatched_file(spark, sf_dir):
    """A file read by its suffix."""
    suffix = ".jsonl"
    path = _written(spark, lambda p: documents(spark, sf_dir, "lang").write.json(p + suffix)) + suffix
    return datasets.load_dataset(spark, path, schema="doc_id bigint, text string, lang string")


@query
def exported_row_results(spark, sf_dir):
    """Row results with a list column exported and read again."""
    rows_ = documents(spark, sf_dir, "lang", "source").select("doc_id", "text", F.array("lang", "source").alias("tags"))
    path = _written(spark, lambda p: datasets.export_row_results(rows_, p))
    return spark.read.schema("doc_id bigint, text string, tags string").options(
        header=True, sep="\t", quote='"', escape='"', multiLine=True, mode="FAILFAST").csv(path)


@query
def active_text(spark, sf_dir):
    """Cleaned anew, a dataset loses what was derived from the older cleaned text."""
    older = documents(spark, sf_dir).withColumn("processed_text", F.upper("text")).withColumn("augmented_text", F.upper("text"))
    newer = rows.drop_stale(older.withColumn("processed_text", F.lower("text")), "processed_text")
    active = rows.active_text_column(newer, "text")
    return newer.select("doc_id", F.lit(active).alias("active"), F.md5(active).alias("digest"),
                        F.lit(len(newer.columns)).cast("bigint").alias("n_columns"))


# --- labels and metrics ----------------------------------------------------------------------


def _judged(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir, "source").join(table(spark, sf_dir, "labels"), "doc_id")
    s = profanity.scan(d, "text", TERMS)
    return s.select("doc_id", "source", F.col("toxic").alias("truth"),
                    F.col("has_profanity").cast("int").alias("guess"))


@query
def row_ids_after_join(spark, sf_dir):
    """Rows of a shuffled join are numbered without loss."""
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    ids = rows.with_row_id(d)
    return ids.agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"),
                   F.count_distinct("row_id").alias("ids"), F.count_distinct("doc_id").alias("docs"))


@query
def split_with_missing_labels(spark, sf_dir):
    """Missing labels are a class of their own: every fourth label is taken away."""
    y = table(spark, sf_dir, "labels").withColumn("y", F.when(F.col("doc_id") % 4 != 0, F.col("toxic")))
    split = model.split_exact(y.select("doc_id", "y"), key="doc_id", label_col="y")
    return split.groupBy(F.coalesce(F.col("y").cast("string"), F.lit("")).alias("label"), "is_test").agg(
        F.count("*").alias("n"))


@query
def label_counts(spark, sf_dir):
    return metrics.class_counts(table(spark, sf_dir, "labels"), "toxic")


@query
def stratify_check(spark, sf_dir):
    return metrics.stratify_check(table(spark, sf_dir, "labels"), "toxic")


@query
def scan_accuracy(spark, sf_dir):
    return metrics.summary(_judged(spark, sf_dir), "truth", "guess")


@query
def scan_report(spark, sf_dir):
    return metrics.report(_judged(spark, sf_dir), "truth", "guess")


@query
def split_hashed(spark, sf_dir):
    d = model.split_by_draw(table(spark, sf_dir, "labels"), key="doc_id")
    return d.select("doc_id", "is_test")


@query
def split_stratified(spark, sf_dir):
    d = model.split_exact(table(spark, sf_dir, "labels"), key="doc_id", label_col="toxic")
    return d.select("doc_id", "toxic", "is_test")


@query
def split_sizes(spark, sf_dir):
    return metrics.split_counts(model.split_exact(
        table(spark, sf_dir, "lineitem").withColumn(
            "k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
        key="k", label_col="l_returnflag"))


# --- features and models -----------------------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


@query
def tfidf_vocabulary(spark, sf_dir):
    return features.vocabulary(documents(spark, sf_dir), "text", "doc_id").select(
        "term", "total", "df")


@query
def knn_predictions(spark, sf_dir):
    split = model.split_by_draw(_labelled(spark, sf_dir), key="doc_id")
    fitted = KNNClassifier(k=7).fit(split.filter(~F.col("is_test")), text_col="text",
                                    label_col="toxic", key="doc_id")
    return fitted.predict(split.filter("is_test")).select("doc_id", "prediction_label")


@query
def model_comparison(spark, sf_dir):
    return model.investigate(_labelled(spark, sf_dir), text_col="text", label_col="toxic",
                             key="doc_id")


@query
def naive_bayes_predictions(spark, sf_dir):
    fitted, _, _ = model.train_selected(_labelled(spark, sf_dir), "Naive Bayes", text_col="text",
                                        label_col="toxic", key="doc_id")
    return fitted.predict(documents(spark, sf_dir)).select("doc_id", "prediction_label")


@query
def naive_bayes_metrics(spark, sf_dir):
    _, scores, _ = model.train_selected(_labelled(spark, sf_dir), "Naive Bayes", text_col="text",
                                        label_col="toxic", key="doc_id")
    return scores.select("samples_train", "samples_test", "accuracy")


def _model_metrics(spark, sf_dir, name: str) -> DataFrame:
    _, scores, _ = model.train_selected(_labelled(spark, sf_dir), name, text_col="text",
                                        label_col="toxic", key="doc_id")
    return scores.select("samples_train", "samples_test", "accuracy", "f1_macro", "f1_weighted")


@query
def logistic_metrics(spark, sf_dir):
    return _model_metrics(spark, sf_dir, "Logistic Regression")


@query
def svm_metrics(spark, sf_dir):
    return _model_metrics(spark, sf_dir, "SVM (LinearSVC)")


@query
def forest_metrics(spark, sf_dir):
    return _model_metrics(spark, sf_dir, "Random Forest")


# --- scoring -------------------------------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    return scoring.prepared(documents(spark, sf_dir), "text",
                            clean.CleanConfig(normalize_whitespace=True), row_id="doc_id")


def faulty_scorer() -> Column:
    """The lexicon scorer with the faults of a language model: some answers of several rows are
    cut off, and in some rows a score is not a whole number."""
    good = lexicon_scorer(TERMS)
    broken = F.regexp_replace(good, r'("row_id":\d*7,"overall_score":)\d+', "$112.5")
    first = F.get(F.col("row_ids"), F.lit(0))
    cut = (F.size("row_ids") > 1) & (first % 2 == 0)
    return bind(broken, lambda b: F.when(cut, F.substring(b, F.lit(1), F.length(b) - 12)).otherwise(b))


def _scored(spark, sf_dir) -> scoring.Scored:
    return scoring.score_dataset(_items(spark, sf_dir), faulty_scorer(), max_rows=8, budget=2_000)


@query
def packed_batches(spark, sf_dir):
    p = scoring.pack(_items(spark, sf_dir), max_rows=8, budget=2_000)
    return p.select("row_id", "batch_id")


@query
def batch_prompts(spark, sf_dir):
    p = scoring.batch_prompts(scoring.pack(_items(spark, sf_dir), max_rows=1), "Rate:\n")
    return p.select("batch_id", F.md5("prompt").alias("prompt"))


@query
def score_rows(spark, sf_dir):
    return scoring.row_results(_scored(spark, sf_dir))


@query
def score_rows_python(spark, sf_dir):
    """The rows scored by a Python function in Arrow batches."""
    return scoring.row_results(scoring.score_dataset(
        _items(spark, sf_dir), python_scorer(TERMS), max_rows=8, budget=2_000))


@query
def score_failures(spark, sf_dir):
    return scoring.error_report(_scored(spark, sf_dir).failed).select("row_id", "n_more")


@query
def score_summary(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return scoring.require_analyzed(scoring.summarize(
        documents(spark, sf_dir), "text", scored, row_id="doc_id"))


@query
def score_top_examples(spark, sf_dir):
    return scoring.top_examples(scoring.row_results(_scored(spark, sf_dir)))


@query
def score_lines_and_bands(spark, sf_dir):
    r = _scored(spark, sf_dir).results
    return r.select("row_id", rows.scores_line(F.col("overall_score")).alias("line"),
                    rows.severity_band(F.col("overall_score")).alias("band"),
                    rows.is_toxic(overall=F.col("overall_score")).alias("toxic_dataset"),
                    rows.is_toxic().alias("toxic_single"))


def answers(d: DataFrame) -> DataFrame:
    """One scorer answer per document in one of six shapes, some of them broken."""
    k, n = F.col("doc_id"), F.length("text") % 101
    kind = F.pmod(k, F.lit(6))
    num = n.cast("string")
    scores = F.format_string("[%d,1,2,3,4,5]", n)
    named = F.format_string(
        '{"toxicity":%d,"severe_toxicity":"7","identity_attack":1.0,"insult":0,"profanity":0,'
        '"threat":0}', n)
    every = ", ".join(f'"{c}"' for c in lex.CATEGORIES)

    def obj(row, overall, six, cats, level, types) -> Column:
        return F.concat(F.lit('{"row_id":'), row, F.lit(',"overall_score":'), overall,
                        F.lit(',"scores":'), six, F.lit(',"category":'), cats,
                        F.lit(',"toxicity_level":'), F.lit(level), F.lit(',"toxicity_type":'),
                        F.lit(types), F.lit("}"))

    row = k.cast("string")
    plain = obj(row, num, scores, F.lit('["profanity","Bogus","PROFANITY","racism"]'), '"high"',
                '["insults","some threats","INSULT"]')
    texty = obj(F.concat(F.lit('"'), row, F.lit('"')), F.concat(F.lit('"'), num, F.lit('"')), named,
                F.lit('"Violence, threats"'), '"unknown"', '"Bullying,id attack"')
    echo = obj(row, num, scores, F.lit(f"[{every}]"), "null", '["Graphic Violence","Insult"]')
    half = obj(row, F.concat(num, F.lit(".5")), scores, F.lit("null"), '"Low"', "[]")
    flag = obj(row, F.lit("true"), scores, F.lit("[]"), '"Severe"', "null")
    raw = (F.when(kind == 0, F.concat(F.lit("Sure! ["), plain, F.lit("] Done.")))
           .when(kind == 1, F.concat(F.lit('{"results": ['), texty, F.lit("]}")))
           .when(kind == 2, F.concat(F.lit("["), echo, F.lit(', {"row_id": 1, "overall_sc')))
           .when(kind == 3, F.concat(F.lit("["), half, F.lit("]")))
           .when(kind == 4, F.concat(F.lit("["), flag, F.lit("]")))
           .otherwise(F.lit('[{"row_id":')))
    return d.select("doc_id", raw.alias("raw"))


@query
def parsed_answers(spark, sf_dir):
    lines = parse.explode_rows(answers(documents(spark, sf_dir)))
    a = parse.analyses(lines)
    return a.select("doc_id", "row_id", "unreadable", F.col("error").isNotNull().alias("invalid"),
                    "overall_score", "toxicity", "severe_toxicity",
                    F.array_join("category", "|").alias("category"), "toxicity_level",
                    F.array_join("toxicity_type", "|").alias("toxicity_type"))


@query
def answer_completeness(spark, sf_dir):
    a = answers(documents(spark, sf_dir))
    return a.select("doc_id", parse.has_complete_container(F.col("raw"), "[").alias("complete"),
                    F.size(parse.completed_row_ids(F.col("raw"))).alias("n_complete"))


@query
def single_answers(spark, sf_dir):
    """One free-form answer per document: valid, with unions in arrays, or not JSON at all."""
    k = F.pmod("doc_id", F.lit(4))
    num = (F.length("text") % 101).cast("string")
    raw = (F.when(k == 0, F.concat(F.lit('Answer: {"overall_score":'), num,
                                   F.lit(',"toxicity_level":"Low"} ok')))
           .when(k == 1, F.concat(F.lit('{"overall_score":'), num,
                                  F.lit(',"category":["Racism" | "Threats" |"None"]}')))
           .when(k == 2, F.lit('{"category":["Racism" "Threats"], "toxicity_level": "High", '
                               '"explanation": "said "so" twice"}'))
           .otherwise(F.lit("no answer")))
    v = documents(spark, sf_dir).withColumn("v", parse.parse_single(raw)).withColumn(
        "echo", parse.looks_like_schema_echo(raw))
    return v.select("doc_id", parse.as_string(parse.field(F.col("v"), "overall_score")).alias("overall"),
                    F.array_join(parse.name_list(parse.field(F.col("v"), "category"), lex.CATEGORIES,
                                                 ["None"]), "|").alias("category"),
                    parse.as_string(parse.field(F.col("v"), "toxicity_level")).alias("level"),
                    parse.as_string(parse.field(F.col("v"), "explanation")).alias("explanation"),
                    "echo")


# --- run history -------------------------------------------------------------------------------------


def runs(spark, sf_dir) -> DataFrame:
    """The event stream read as a run log."""
    e = table(spark, sf_dir, "events")
    n = F.floor("value").cast("bigint")
    toxic = F.floor(n / 3).cast("bigint")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("run_type"),
        F.lit(None).cast("string").alias("source_filename"), n.alias("row_count"),
        toxic.alias("toxic_count"), (n - toxic).alias("non_toxic_count"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "Overall: ").otherwise("Run "), "props",
                 F.lit("\nbody of "), "event_type").alias("summary"),
        F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("results_path"))


@query
def history_written(spark, sf_dir):
    """Runs appended in two parts, one user's results placed, another user's runs deleted."""
    log = history.RunHistory(spark, _written(spark, lambda path: None))
    e = runs(spark, sf_dir).drop("id")
    log.append(e.filter("user_id <= 50"))
    log.append(e.filter("user_id > 50"))
    log.update_results_path(log.read().filter("user_id = 9").select("id", F.lit("/results/9").alias("results_path")))
    log.clear_user(8)
    return log.read().groupBy("run_type").agg(
        F.count("*").alias("n"), F.sum("row_count").alias("rows"), F.countDistinct("id").alias("ids"),
        F.count("results_path").alias("placed"))


@query
def run_record(spark, sf_dir):
    """The record of a scoring job over all documents."""
    facts = scoring.summary_text(score_summary(spark, sf_dir))
    return history.dataset_run(facts, user_id=1, source_filename="documents").drop("summary")


@query
def dataset_report(spark, sf_dir):
    """The report of a scoring job over all documents: facts, highest rows, first failed rows."""
    report = scoring.full_report(documents(spark, sf_dir), "text", _scored(spark, sf_dir), source_name="documents")
    return report.select("analyzed", "scores_line", "report")


@query
def history_totals(spark, sf_dir):
    return history.totals(runs(spark, sf_dir))


@query
def history_timeline(spark, sf_dir):
    return history.timeline(runs(spark, sf_dir))


@query
def history_of_user(spark, sf_dir):
    return history.runs_of_user(runs(spark, sf_dir), 8, 5).select("id", "run_type", "row_count")


@query
def history_newest_per_user(spark, sf_dir):
    return history.newest_runs_per_user(runs(spark, sf_dir), 3).select("user_id", "id")


@query
def history_one_run(spark, sf_dir):
    r = runs(spark, sf_dir)
    return history.run_of_owner(r, 0, 8).unionByName(history.run_of_owner(r, 1, 8)).select(
        "id", "user_id", "run_type")


@query
def history_without_user(spark, sf_dir):
    kept = history.without_user(runs(spark, sf_dir), 8)
    return kept.groupBy("run_type").agg(F.count(F.lit(1)).alias("n"), F.sum("row_count").alias("rows"))


@query
def history_with_paths(spark, sf_dir):
    r = runs(spark, sf_dir)
    patch = r.filter("id % 10 = 3").select("id", F.concat(F.lit("/results/"), "id").alias("results_path"))
    return history.with_results_path(r, patch).select("id", "results_path")


@query
def history_summaries(spark, sf_dir):
    return runs(spark, sf_dir).select("id", history.summary_column(F.col("summary")).alias("head"),
                                      history.preview_body(F.col("summary")).alias("body"))

