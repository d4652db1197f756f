"""Reading scorer answers."""

import json

import pytest
from pyspark.sql import functions as F

from commentmill.operators import parse

SIX = {"toxicity": 41, "severe_toxicity": 2, "identity_attack": 5, "insult": 37, "profanity": 11, "threat": 3}
ROW = {"row_id": 70, "overall_score": 4, "scores": dict.fromkeys(SIX, 2), "category": ["None"],
       "toxicity_level": "Low", "toxicity_type": []}
CUT = json.dumps([{"row_id": i, "toxicity_level": "Medium", "category": ["Profanity"], "explanation": f"line {i}, {{ok}}"}
                  for i in (31, 12, 44)])[:-60]


def rows_of(column, raw):
    got = column(lambda c: F.transform(parse.parse_rows(c), lambda v: v.cast("string")), [raw])[0]
    return None if got is None else [json.loads(g) for g in got]


def analysis(spark, **fields):
    df = spark.createDataFrame([(json.dumps({**ROW, **fields}),)], "t string")
    return parse.analyses(df.select(F.parse_json("t").alias("obj"))).drop("obj").first()


def test_whole_array(column):
    assert rows_of(column, json.dumps([ROW])) == [ROW]
    assert rows_of(column, "Sure: " + json.dumps([ROW]) + " done") == [ROW]
    assert rows_of(column, json.dumps({"results": [ROW]})) == [ROW]


def test_cut_off_array_keeps_complete_rows(column):
    assert [r["row_id"] for r in rows_of(column, CUT)] == [31, 12]


def test_nothing_complete(column):
    assert rows_of(column, '[{"row_id": 5, "toxicity_level": "Lo') is None
    assert rows_of(column, None) is None


def test_salvage_keeps_the_first_of_an_id_and_skips_braces_in_text(column):
    raw = '[{"row_id":1,"e":"a } b { \\" c"},{"row_id":1,"e":"x"},{"row_id":"2","s":{"a":{"b":1}}},{"row_id":'
    assert [(r["row_id"], r.get("e")) for r in rows_of(column, raw)] == [(1, 'a } b { " c'), ("2", None)]


def test_text_after_a_value_is_not_json(column):
    got = column(lambda c: parse.strict_json(c).cast("string"), ["[1]", "[1] x", "1], [2", "1}, {2", '{"a":1}', "", "1,2"])
    assert got == ["[1]", None, None, None, '{"a":1}', None, None]


def test_array_scores_by_position(spark):
    r = analysis(spark, overall_score=60, scores=[60, 51, 42, 33, 24, 15])
    assert r["error"] is None and r["overall_score"] == 60
    assert [r[c] for c in SIX] == [60, 51, 42, 33, 24, 15]


def test_scores_are_not_derived_from_labels(spark):
    r = analysis(spark, overall_score=19, scores=SIX, category=["Violence"], toxicity_level="Severe",
                 toxicity_type=["Graphic Violence"], explanation="\n reason ")
    assert r["overall_score"] == 19 and r["threat"] == 3 and r["insult"] == 37
    assert (r["category"], r["toxicity_level"], r["toxicity_type"], r["explanation"]) == (
        ["Violence"], "Severe", ["Graphic Violence"], "reason")


@pytest.mark.parametrize("scores", [{"insult": 9, "threat": 1}, [9, 8], "[9,8,7,6,5,4]", None, 77, [9, 8, 7, 6, 5, False]])
def test_every_score_is_required(spark, scores):
    assert analysis(spark, scores=scores)["error"]


@pytest.mark.parametrize("value,want", [(0, 0), (100, 100), ("65", 65), (65.0, 65), (" 7 ", 7), (1e1, 10), (101, None),
                                        (-1, None), (12.5, None), (True, None), (None, None), ("high", None), ("65d", None)])
def test_one_score(spark, value, want):
    r = analysis(spark, overall_score=value)
    assert r["overall_score"] == want and (r["error"] is None) == (want is not None)


def test_names(spark):
    r = analysis(spark, category="violence, THREATS,foo,violence", toxicity_level="severe", toxicity_type=
                 ["insults", "veiled threat", "ID attack", "identity-based attack", "bullying", None])
    assert r["category"] == ["Violence", "Threats"] and r["toxicity_level"] == "Severe"
    assert r["toxicity_type"] == ["Threat", "Identity Attack", "Bullying"]
    r = analysis(spark, category=None, toxicity_level=3, toxicity_type=None)
    assert (r["category"], r["toxicity_level"], r["toxicity_type"]) == (["None"], "Low", [])


def test_echoed_lists(spark):
    from commentmill.functions.lexicons import CATEGORIES, TOXICITY_TYPES
    r = analysis(spark, category=list(CATEGORIES), toxicity_type=list(TOXICITY_TYPES))
    assert r["category"] == ["Threats"] and r["toxicity_type"] == []
    r = analysis(spark, category=list(CATEGORIES), toxicity_type=["Political Abuse", "Insult"])
    assert r["category"] == ["Political Extremism"]


def test_alias_of_types(spark):
    df = spark.createDataFrame([('{"toxicity_types":["Insult"]}',), ('{"toxicity_type":null,"toxicity_types":["Insult"]}',)], "t string")
    got = parse.analyses(df.select(F.parse_json("t").alias("obj"))).select("toxicity_type").collect()
    assert [r[0] for r in got] == [["Insult"], []]


def test_completeness(column):
    values = ['note: ["a [b", {"c": "]"}] and more', '[{"row_id": 8}', "[}", 'said "[" then [9]', "no list", '["x\\"]"']
    assert column(lambda c: parse.has_complete_container(c, "["), values) == [True, False, False, False, False, False]
    cut = '[{"row_id": 9, "scores": {"a": 1}}, {"row_id": 3}, {"row_id": 6, "scores": {"a"'
    assert column(parse.completed_row_ids, [cut]) == [[3, 9]]


def test_salvage_reads_any_depth(column):
    deep = '{"row_id": 5, "x": ' + '{"y": ' * 30 + '"}{"' + "}" * 30 + "}"
    assert [r["row_id"] for r in rows_of(column, "[" + deep + ', {"row_id": 6')] == [5]
    inner = '[{"row_id": 1, "open": {"row_id": 2, "k": "v"}, "never": '
    assert [r["row_id"] for r in rows_of(column, inner)] == [2]


def test_the_last_of_repeated_keys_counts(spark, column):
    parse.allow_repeated_keys(spark)
    got = rows_of(column, '[{"row_id": 4, "category": ["Racism"], "category": ["Threats"]}]')
    assert got == [{"row_id": 4, "category": ["Threats"]}]
    assert column(parse.completed_row_ids, ['{"row_id": 4, "a": 1, "a": 2}']) == [[4]]


def test_single_result(column):
    texts = ['{"overall_score":3,"category":["A" | "B" |  "C"]}', 'junk {"tasks":[]} {"category":["X"],"toxicity_level":"High"}',
             '{"toxicity_level":"High","category":["X" "Y"],"explanation":"a "b" c"}', "nothing"]
    got = [g and json.loads(g) for g in column(lambda c: parse.parse_single(c).cast("string"), texts)]
    assert got[0] == {"overall_score": 3, "category": ["A", "B", "C"]}
    assert got[1] == {"category": ["X"], "toxicity_level": "High"}
    assert (got[2]["toxicity_level"], got[2]["category"], got[2]["explanation"]) == ("High", ["X", "Y"], 'a "b" c')
    assert got[3] is None


def test_schema_echo(column):
    long = '{"tasks": [' + "1," * 300 + "]}"
    assert column(parse.looks_like_schema_echo, ["ALLOWED_CATEGORIES", long, '{"tasks": []}']) == [True, True, False]
