"""Canonical JSON against plain rules, and schemas as column rules."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import documents as doc
from quillon.operators import json_rules


def plain_number(x):
    """A number as scripts write it: the shortest digits that give the double, plain up to 21 places."""
    if not math.isfinite(x := float(x)):
        return "null"
    if x == 0:
        return "0"
    sign, text = "-" * (x < 0), repr(abs(x))
    mantissa, _, power = text.partition("e")
    whole, _, part = mantissa.partition(".")
    digits, n = (whole + part).lstrip("0"), len(whole) + int(power or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return sign + digits[:n] + "." + digits[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + digits
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + ("e+" if n > 0 else "e-") + str(abs(n - 1))


def plain(value, indent=None, level=0):
    gap, end, colon = ("", "", ":") if indent is None else ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level, ": ")
    if isinstance(value, dict):
        index = lambda k: int(k) if k.isascii() and k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1 else 2**32
        items = [plain_string(k) + colon + plain(value[k], indent, level + 1) for k in sorted(value, key=lambda k: (index(k), k.encode("utf-16-be")))]
        return "{" + (gap + f",{gap}".join(items) + end if items else "") + "}"
    if isinstance(value, list):
        items = [plain(x, indent, level + 1) for x in value]
        return "[" + (gap + f",{gap}".join(items) + end if items else "") + "]"
    if isinstance(value, str):
        return plain_string(value)
    return {True: "true", False: "false", None: "null"}[value] if value is None or isinstance(value, bool) else plain_number(value)


def plain_string(s):
    return json.dumps(s, ensure_ascii=False)


def random_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind in (1, 2):
        return rng.choice([0, -0.0, 1.0, 1e21, 1e-7, 123456789012, 0.1, -2.5e-9, 5e-324, 1.7976931348623157e308, 1e20, 12345678901234567890, 100, 0.000001, rng.randrange(10**9), rng.random(), rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30)])
    if kind < 6:
        return "".join(rng.choice(["a", "é", "語", "😀", "￮", '"', "\\", "/", "\n", "\x01", "\x1f", " ", " ", "7"]) for _ in range(rng.randrange(6)))
    if kind == 6:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = {rng.choice(["a", "b", "B", "10", "9", "007", "é", "😀", "￮", "", "x y", "4294967295", 'q"', "$.a"]) for _ in range(rng.randrange(6))}
    return {k: random_value(rng, depth - 1) for k in keys}


def test_canonical_text(spark):
    rng = random.Random(12)
    docs = [random_value(rng, 4) for _ in range(300)]
    rows = [(i, json.dumps(d, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, d in enumerate(docs)] + [(1000, "{"), (1001, None), (1002, '{"a":1,"a":2}'), (1003, "1e400")]
    rows += [(2000 + k, t) for k, t in enumerate(['{"a":1}}', "1 2", "1] [2", "1,2", '1,"v":2', "", " ", "[1]]", '{"a":1} x'])]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: (r.c, r.p) for r in df.select("i", doc.canonical_json(F.col("t")).alias("c"), doc.canonical_json(F.col("t"), indent=2).alias("p")).collect()}
    shown = lambda x: repr(x).count("e+308") or "5e-324" in repr(x)
    for i, d in enumerate(docs):
        if not shown(d):
            assert got[i] == (plain(d), plain(d, 2) + "\n"), rows[i][1]
    assert got[1000] == got[1001] == got[1002] == (None, None) and got[1003][0] == "null"
    assert {got[i] for i in got if i >= 2000} == {(None, None)}


def test_digests_and_depth(spark):
    import hashlib

    df = spark.createDataFrame([('{"b": 1, "digest": "x", "a": {"digest": 2}}',)], "t string")
    r = df.select(doc.document_digest(F.col("t"), "digest").alias("d"), doc.document_digest(F.col("t")).alias("w")).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.d, r.w) == (sha('{"a":{"digest":2},"b":1}'), sha('{"a":{"digest":2},"b":1,"digest":"x"}'))
    deep = spark.createDataFrame([("[" * 4 + "1" + "]" * 4,)], "t string")
    assert deep.select(doc.canonical_json(F.col("t"), depth=4)).first()[0] == "[[[[1]]]]"
    with pytest.raises(Exception, match="levels"):
        deep.select(doc.canonical_json(F.col("t"), depth=3)).collect()


SCHEMA = {
    "$schema": "x", "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+-[0-9]+$", "maxLength": 8}, "kind": {"enum": ["a", "b", None, 3]}, "n": {"type": ["integer", "null"], "minimum": 0, "exclusiveMaximum": 10}, "ratio": {"$ref": "#/$defs/ratio"},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "string", "minLength": 2}}, "map": {"type": "object", "additionalProperties": {"$ref": "#/$defs/ratio"}}, "one": {"oneOf": [{"type": "string"}, {"const": "x"}]},
        "any": {"anyOf": [{"type": "string"}, {"type": "number", "minimum": 5}]}, "no": {"not": {"type": "null"}}, "flag": {"const": True},
    },
    "allOf": [{"if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["n"]}, "else": {"properties": {"n": False}}}],
    "$defs": {"ratio": {"type": "number", "minimum": 0, "maximum": 1}},
}


def test_schema_faults(spark):
    good = {"id": "ab-1", "kind": "a", "n": 3}
    cases = {
        "[]": ["/: type object"], "nope": ["/: no JSON"], json.dumps(good): [], json.dumps(good | {"n": 3.0, "ratio": 0, "tags": ["aa"], "map": {}, "one": "y", "any": 6, "no": 1, "flag": True}): [],
        json.dumps({"kind": "b"}): ["/id: required"], json.dumps(good | {"id": "Ab-1", "zz": 1, "aa": 1}): ["/id: pattern ^[a-z]+-[0-9]+$", "/aa: unknown property", "/zz: unknown property"],
        json.dumps(good | {"id": "abcdefgh-1"}): ["/id: maxLength 8"], json.dumps(good | {"id": 5}): ["/id: type string"], json.dumps(good | {"kind": "c", "n": ...}, default=lambda _: 1): ["/kind: enum", "/n: nothing is allowed here"],
        json.dumps({"id": "a-1", "kind": 3.0}): [], json.dumps({"id": "a-1", "kind": None}): [], json.dumps({"id": "a-1", "kind": "a"}): ["/n: required"], json.dumps(good | {"n": -1}): ["/n: minimum 0"], json.dumps(good | {"n": 10}): ["/n: exclusiveMaximum 10"],
        json.dumps(good | {"n": 1.5}): ["/n: type integer|null"], json.dumps(good | {"ratio": 2}): ["/ratio: maximum 1"], json.dumps(good | {"tags": []}): ["/tags: minItems 1"], json.dumps(good | {"tags": ["aa", "b", 1, "cc"]}): ["/tags: maxItems 3", "/tags/1: minLength 2", "/tags/2: type string"],
        json.dumps(good | {"map": {"y": 7, "x": "s"}}): ["/map/x: type number", "/map/y: maximum 1"], json.dumps(good | {"one": "x"}): ["/one: oneOf"], json.dumps(good | {"any": 4}): ["/any: anyOf"], json.dumps(good | {"no": None}): ["/no: not"], json.dumps(good | {"flag": 1}): ["/flag: const"],
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want array<string>")
    for r in df.select("t", "want", json_rules.faults(F.col("t"), SCHEMA).alias("got")).collect():
        assert r.got == r.want, r.t
    ok, bad = json_rules.hold(df.unionByName(spark.createDataFrame([(None, [])], df.schema)), "t", SCHEMA)
    assert ok.count() == 4 and bad.count() == len(cases) + 1 - 4


def test_what_is_not_compiled_is_refused():
    for schema in ({"dependentSchemas": {}}, {"properties": {"a": {"uniqueItems": True}}}, {"$ref": "http://x"}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            json_rules._faults(F.lit(None), schema, F.lit(""), schema, 5)
    loop = {"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"}
    with pytest.raises(ValueError, match="refers to itself"):
        json_rules._faults(F.lit(None), loop, F.lit(""), loop, 6)
