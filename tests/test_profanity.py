"""Scan and sanitise: texts and what must come of them, written by hand."""

import pytest
from pyspark.sql import functions as F

from commentmill.functions import lexicons as lex
from commentmill.operators import profanity

TERMS = ["trash", "moron", "stupid", "idiot", " Scum ", "", "trash"]
#: text -> terms found
FOUND = {
    "": [],
    "  ": [],
    "clean words": [],
    "Trash, TRASHES trash's trashing trasher": ["trash"],
    "class trash_can xtrash trash1": ["trash"],  # the underscore is blanked in the undisguised text
    "m0r0n $tupid !d1ot": ["moron", "stupid", "idiot"],
    "t r a s h and tr-as.h": [],
    "idiot then scum": ["idiot", "scum"],
    "scum.trash;moron": ["scum", "trash", "moron"],
    "étrash trashé": ["trash"],  # letters with accents are blanked there too
}
#: text -> text with masks, terms replaced
MASKED = {
    "": ("", []),
    "  ": ("  ", []),
    "clean words": ("clean words", []),
    "Trash, TRASHES day": ("#, # day", ["trash"]),
    "class trash_can xtrash": ("class trash_can xtrash", []),
    "t r a s h and tr-as.h": ("# and #", ["trash"]),
    "S.t-u p*i_d": ("#", ["stupid"]),
    "idiots i.d.i.o.t": ("# i.d.i.o.t", ["idiot"]),  # a term replaced as a word is not looked for apart
    "i.d.i.o.t m o r o n": ("# #", ["idiot", "moron"]),
    "scum.trash;moron": ("#.#;#", ["scum", "trash", "moron"]),
}


def test_scan(spark):
    df = spark.createDataFrame([(t,) for t in FOUND], "t string")
    for r in profanity.scan(df, "t", TERMS).collect():
        assert r["profanity_matches"] == FOUND[r["t"]], r["t"]
        assert r["profanity_count"] == len(FOUND[r["t"]])
        assert r["has_profanity"] == bool(FOUND[r["t"]])


def test_terms_that_end_in_symbols(spark):
    df = spark.createDataFrame([("a a$$es b",), ("a$$ alone",)], "t string")
    got = {r["t"]: r["profanity_matches"] for r in profanity.scan(df, "t", ["a$$"]).collect()}
    assert got == {"a a$$es b": ["a$$"], "a$$ alone": []}  # a symbol has no word boundary before a space


def test_mask(spark):
    df = spark.createDataFrame([(t,) for t in MASKED], "t string")
    for r in profanity.sanitize(df, "t", TERMS, mask_token="#").collect():
        assert (r["clean_text"], r["clean_replacements"]) == MASKED[r["t"]], r["t"]


def test_phrases_are_put_in_as_they_are(spark):
    df = spark.createDataFrame([("trash and idiot, scum",)], "t string")
    r = profanity.sanitize(df, "t", TERMS, mode="replace", mask_token="[x\\$]",
                           replacement_map={"trash": "$1 mo-ron", "idiot": "s.tupid"}).first()
    # what a phrase spells with separators is found in the second stage
    assert r["clean_text"] == "$1 [x\\$] and [x\\$], [x\\$]"
    assert r["clean_replacements"] == ["trash", "idiot", "scum", "moron", "stupid"]


def test_default_lists_and_errors(spark):
    df = spark.createDataFrame([("what a shitty, bullshit b.i.t.c.h day",)], "t string")
    r = profanity.sanitize(df, "t", mode="replace").first()
    assert r["clean_text"] == "what a shitty, [censored] rude person day"
    assert r["clean_replacements"] == ["bullshit", "bitch"]
    assert profanity.normalize_terms() == sorted(lex.PROFANITY_TERMS)
    with pytest.raises(ValueError):
        profanity.sanitize_expr(F.col("t"), mode="delete")
    assert profanity.scan(df, "t", []).first()["profanity_matches"] == []
