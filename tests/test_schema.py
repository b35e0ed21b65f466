import json

import pytest

from lureline.operators import schema
from lureline.plans.catalog import QUERIES

DOCUMENT = {
    "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False,
    "required": ["id", "kind", "text", "made", "parts", "safe"],
    "properties": {
        "id": {"type": "string", "pattern": "^R-[0-9]{3}$"}, "kind": {"type": "string", "enum": ["one", "two"]}, "text": {"type": "string", "minLength": 3, "maxLength": 8},
        "made": {"type": "string", "format": "date"}, "version": {"const": "1"}, "share": {"type": "number", "minimum": 0, "maximum": 1}, "n": {"type": ["integer", "null"], "minimum": 1},
        "tags": {"type": "array", "items": {"type": "string", "minLength": 2}, "uniqueItems": True, "minItems": 1, "maxItems": 3},
        "parts": {"type": "array", "items": {"type": "object", "required": ["role", "said"], "properties": {"role": {"enum": ["a", "b"]}, "said": {"type": "string", "minLength": 1}}}},
        "safe": {"type": "boolean", "const": True},
    },
}
GOOD = {"id": "R-001", "kind": "one", "text": "hello", "made": "2025-02-28", "version": "1", "share": 0.5, "n": None, "tags": ["xy", "yz"], "parts": [{"role": "a", "said": "x"}], "safe": True}

BAD = [
    ({"id": "X-1"}, {"id.pattern"}), ({"id": None}, {"id.required"}), ({"kind": "three"}, {"kind.enum"}), ({"text": "ab"}, {"text.minLength"}), ({"text": "much too long"}, {"text.maxLength"}),
    ({"made": "2025-02-30"}, {"made.format"}), ({"made": "28.2.2025"}, {"made.format"}), ({"version": "2"}, {"version.const"}), ({"share": -0.1}, {"share.minimum"}), ({"share": 1.5}, {"share.maximum"}), ({"n": 0}, {"n.minimum"}),
    ({"tags": []}, {"tags.minItems"}), ({"tags": ["ab", "ab"]}, {"tags.uniqueItems"}), ({"tags": ["ab", "cd", "ef", "gh"]}, {"tags.maxItems"}), ({"tags": ["a"]}, {"tags.items.minLength"}),
    ({"parts": [{"role": "c", "said": "x"}]}, {"parts.items.role.enum"}), ({"parts": [{"role": "a"}]}, {"parts.items.said.required"}), ({"parts": [{"role": "a", "said": ""}]}, {"parts.items.said.minLength"}),
    ({"safe": False}, {"safe.const"}), ({"other": 1}, {"unknown:other"}), ({"kind": "x", "more": {}, "safe": False}, {"kind.enum", "unknown:more", "safe.const"}),
]


def found(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    out = {i: set() for i in range(len(lines))}
    for r in schema.line_violations(df, ["k"], "line", DOCUMENT).collect():
        out[r.k].add(r.constraint)
    return [out[i] for i in range(len(lines))]


def test_a_violation_of_each_kind(spark):
    lines = [json.dumps(GOOD), json.dumps({k: v for k, v in GOOD.items() if k not in ("version", "share", "n", "tags")}), *(json.dumps({**GOOD, **change}) for change, _ in BAD)]
    assert found(spark, lines) == [set(), set(), *(want for _, want in BAD)]


def test_what_is_no_object(spark):
    assert found(spark, ["[1]", "no json", '"text"']) == [{"json"}] * 3


def test_tables_and_no_rows(spark):
    df = spark.createDataFrame([("R-001", "one"), ("R-1", None)], "id string, kind string")
    small = {"type": "object", "required": ["kind"], "properties": {"id": {"pattern": "^R-[0-9]{3}$"}, "kind": {"enum": ["one"]}}}
    rows = schema.violations(df, ["id"], schema.constraints(small)).collect()
    assert {tuple(r) for r in rows} == {("R-1", "id.pattern"), ("R-1", "kind.required")}
    assert schema.line_violations(spark.createDataFrame([], "k long, line string"), ["k"], "line", DOCUMENT).count() == 0


@pytest.mark.parametrize("wrong", [{"type": "string", "oneOf": []}, {"type": ["string", "integer"]}, {"type": "string", "format": "email"}])
def test_what_is_not_known_is_an_error(wrong):
    with pytest.raises(ValueError, match="unknown|one type"):
        schema.constraints({"type": "object", "properties": {"x": wrong}})


def test_turns_of_a_system_and_beyond_the_last_place_are_violations(spark, tmp_path):
    """both had left the query together with its SQL."""
    said = "a turn of forty characters or more, as it should be"
    turns = [(1, 0, "system", said), (1, 1, "user", said), (1, 199, "assistant", said), (1, 200, "user", said)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["p23_schema_violations"](spark, str(tmp_path)).collect()
    assert {(r.table_name, r.constraint, r.rows) for r in rows} == {("conversations", "role", 1), ("conversations", "turn", 1)}
