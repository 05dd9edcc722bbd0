"""Type texts as trees and schemas."""

import json

import pytest

from loomdoc.operators import type_trees

OBJECT, STRING, NUMBER = {"type": "object"}, {"type": "string"}, {"type": "number"}


def ref(name):
    return {"$ref": f"#/components/schemas/{name}"}


def listed(items):
    return {"type": "array", "items": items}


CASES = {
    "string": STRING, "bigint": {"type": "integer", "format": "int64"}, "any": {}, "never": {"not": {}}, "Date": {"type": "string", "format": "date-time"}, "User": ref("User"), "": OBJECT, "null": {"type": "null"},
    "string[]": listed(STRING), "User[][]": listed(listed(ref("User"))), "Array<Map<string, Set<User>>>": listed({"type": "object", "additionalProperties": {"type": "array", "items": ref("User"), "uniqueItems": True}}),
    "Set<Date>": {"type": "array", "items": {"type": "string", "format": "date-time"}, "uniqueItems": True}, "Set": {"type": "array", "uniqueItems": True}, "Array": {"type": "array"}, "Promise": {}, "Map": {"type": "object", "additionalProperties": True},
    "Record<string, number>": {"type": "object", "additionalProperties": NUMBER}, "Map<'a' | 'b', X>": {"type": "object", "additionalProperties": ref("X"), "propertyNames": {"type": "string", "enum": ["a", "b"]}},
    "Record<number, X[]>": {"type": "object", "additionalProperties": listed(ref("X")), "propertyNames": NUMBER}, "Promise<Readonly<User>[]>": listed(ref("User")),
    "'a' | \"b\" | null": {"type": "string", "enum": ["a", "b"], "nullable": True}, "1 | 2.5": {"type": "number", "enum": [1, 2.5]}, "true | false": {"type": "boolean", "enum": [True, False]}, "'a' | 1": {"oneOf": [{"type": "string", "enum": ["a"]}, {"type": "number", "enum": [1]}]},
    "A | B | undefined": {"oneOf": [ref("A"), ref("B")]}, "A | null": {**ref("A"), "nullable": True}, "A | undefined": ref("A"), "| A | B": {"oneOf": [ref("A"), ref("B")]}, "(A | null)[]": listed({**ref("A"), "nullable": True}), "(A | null) | null": {**ref("A"), "nullable": True},
    "null | undefined": {"oneOf": [], "nullable": True}, "'it\\'s, a | b'": {"type": "string", "enum": ["it's, a | b"]},
    "{ a: string; b?: number, readonly c: X }": {"type": "object", "properties": {"a": STRING, "b": NUMBER, "c": {**ref("X"), "readOnly": True}}, "required": ["a", "c"]},
    "{\n  a: string // first, one\n  'b-c'?:\n    | A\n    | B\n  m(x: A): void\n}": {"type": "object", "properties": {"a": STRING, "b-c": {"oneOf": [ref("A"), ref("B")]}}, "required": ["a"]},
    "{ [key: string]: Set<A> | null; id: string }": {"type": "object", "properties": {"id": STRING}, "required": ["id"], "additionalProperties": {"type": "array", "items": ref("A"), "uniqueItems": True, "nullable": True}}, "{}": {"type": "object", "properties": {}},
    "{ a: { b: { c: [A, B?, ...C[]] } } }[]": listed({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "object", "properties": {"c": {"type": "array", "prefixItems": [ref("A"), ref("B")], "items": ref("C"), "minItems": 1}}, "required": ["c"]}}, "required": ["b"]}}, "required": ["a"]}),
    "[x: A, y?: string]": {"type": "array", "prefixItems": [ref("A"), STRING], "items": False, "minItems": 1, "maxItems": 2}, "[]": {"type": "array", "prefixItems": [], "items": False, "minItems": 0, "maxItems": 0}, "[...A[]]": {"type": "array", "items": ref("A"), "minItems": 0},
    "{ a: A } & { b?: B; a: string }": {"type": "object", "properties": {"a": STRING, "b": ref("B")}, "required": ["a"]}, "string & { __brand: 'x' }": STRING, "A & B": {"type": "object", "properties": {}}, "A & { x: A } | B": {"oneOf": [{"type": "object", "properties": {"x": ref("A")}, "required": ["x"]}, ref("B")]},
    "readonly string[]": {"type": "array", "items": STRING, "readOnly": True}, "keyof { a: A; b: B }": {"type": "string", "enum": ["a", "b"]}, "keyof User": STRING, "(a: A, b: B) => C | D": {}, "{ f: (a: A) => void; g: A }": {"type": "object", "properties": {"f": {}, "g": ref("A")}, "required": ["f", "g"]},
    "[A, string][1]": STRING, "[A][3]": OBJECT, "{ a: A[] }['a'][0]": ref("A"), "{ a: A }['b']": OBJECT, "A['b']": OBJECT, "`x-y`": {"type": "string", "enum": ["x-y"]}, "`id.${number}`": {"type": "string", "pattern": "^id\\.\\d+$"}, "`a${Name}`": STRING, "A extends B ? C : D": OBJECT, "Page<User>": ref("Page"),
}


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame([*enumerate(CASES), (-1, None)], "k long, text string")
    return {r["k"]: r["schema"] for r in type_trees.type_schemas(rows, "k").collect()}


def test_schemas(made):
    texts = list(CASES)
    wrong = {texts[k]: made[k] for k in range(len(texts)) if json.loads(made[k]) != CASES[texts[k]]}
    assert not wrong and json.loads(made[-1]) == OBJECT


def test_deep_nesting_and_no_rows(spark):
    depth = 11
    text, want = "A", ref("A")
    for i in range(depth):
        text, want = (f"Set<{text}>", {"type": "array", "items": want, "uniqueItems": True}) if i % 2 else (f"{{ p: {text} }}", {"type": "object", "properties": {"p": want}, "required": ["p"]})
    found = type_trees.type_schemas(spark.createDataFrame([(1, text)], "k long, text string"), "k").first()
    assert json.loads(found["schema"]) == want
    assert type_trees.type_schemas(spark.createDataFrame([], "k long, text string"), "k").count() == 0


def test_tree_rows(spark):
    rows = type_trees.type_tree(spark.createDataFrame([(1, "Map<string, {a: 'x' | B[]}> | null")], "k long, text string"), "k").collect()
    by = {r["text"]: r for r in rows}
    assert {t: r["kind"] for t, r in by.items()} == {"Map": "generic", "string": "name", "{": "object", "'x'": "literal", "B": "name", "null": "name"}
    assert by["Map"]["parent"] is None and by["{"]["parent"] == by["Map"]["node"] == by["string"]["parent"] and by["B"]["parent"] == by["{"]["node"]
    assert tuple(by["B"]["ord"]) == (0, 1, 0) and tuple(by["{"]["ord"]) == (1, 0, 0) and tuple(by["null"]["ord"]) == (0, 1, 0)
