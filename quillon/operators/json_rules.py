"""JSON Schema as column rules: a compiler from a schema to one expression that names every fault of a document with its path.

Keywords: $ref (within the schema), type, enum, const, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, minItems, maxItems, required, properties, additionalProperties, items, allOf, anyOf, oneOf, not, if/then/else.
A keyword that asks for one type says nothing about values of another. format, title and the like tell nothing; any other
keyword is an error when the schema is compiled, so that no rule is passed over in silence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import documents as doc

RULES = {
    "$ref", "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "required", "properties",
    "additionalProperties", "items", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
SILENT = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
NONE = "array<string>"


def _resolve(root: dict, ref: str) -> dict:
    if not ref.startswith("#"):
        raise ValueError(f"a reference out of the schema: {ref}")
    at = root
    for part in [p.replace("~1", "/").replace("~0", "~") for p in ref[1:].split("/") if p]:
        at = at[part]
    return at


def _none() -> Column:
    return F.array().cast(NONE)


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _is_type(value: Column, kinds: str | list[str]) -> Column:
    kind, number = doc.type_of(value), F.try_variant_get(value, "$", "double")
    out = F.lit(False)
    for k in [kinds] if isinstance(kinds, str) else kinds:
        out = out | ((kind == "number") & (number == F.floor(number)) if k == "integer" else kind == k)
    return out


def _equals(value: Column, allowed: list) -> Column:
    """Whether the value is one of plain values (no arrays or objects)."""
    if any(isinstance(x, dict | list) for x in allowed):
        raise ValueError("enum and const are compiled for plain values only")
    kind, out = doc.type_of(value), F.lit(False)
    strings = [x for x in allowed if isinstance(x, str)]
    numbers = [float(x) for x in allowed if isinstance(x, int | float) and not isinstance(x, bool)]
    if strings:
        out = out | ((kind == "string") & F.try_variant_get(value, "$", "string").isin(*strings))
    if numbers:
        out = out | ((kind == "number") & F.try_variant_get(value, "$", "double").isin(*numbers))
    for x in (True, False, None):
        if any(x is y for y in allowed):
            out = out | (F.to_json(value) == {True: "true", False: "false", None: "null"}[x])
    return F.coalesce(out, F.lit(False))


def _faults(value: Column, schema: dict | bool, path: Column, root: dict, depth: int) -> Column:
    """The faults of a VARIANT value that is there."""
    say = lambda rule, at=path: F.concat(F.when(at == "", "/").otherwise(at), F.lit(f": {rule}"))
    if depth < 0:
        raise ValueError("the schema refers to itself: give a depth that its documents do not pass")
    if schema is True:
        return _none()
    if schema is False:
        return F.array(say("nothing is allowed here"))
    if unknown := set(schema) - RULES - SILENT:
        raise ValueError(f"keywords that are not compiled: {sorted(unknown)}")
    inner = lambda v, s, p=path: _faults(v, s, p, root, depth - 1)
    parts: list[Column] = []
    check: Callable[[Column, str], None] = lambda bad, rule: parts.append(F.when(F.coalesce(bad, F.lit(False)), F.array(say(rule))).otherwise(_none()))
    if "$ref" in schema:
        parts.append(inner(value, _resolve(root, schema["$ref"])))
    if "type" in schema:
        check(~_is_type(value, schema["type"]), f"type {schema['type'] if isinstance(schema['type'], str) else '|'.join(schema['type'])}")
    if "enum" in schema:
        check(~_equals(value, schema["enum"]), "enum")
    if "const" in schema:
        check(~_equals(value, [schema["const"]]), "const")
    text, number = doc.as_string(value), F.when(doc.type_of(value) == "number", F.try_variant_get(value, "$", "double"))
    array, fields = doc.as_array(value), doc.as_map(value)
    for name, bad in (("pattern", lambda x: ~text.rlike(x)), ("minLength", lambda x: F.length(text) < x), ("maxLength", lambda x: F.length(text) > x), ("minimum", lambda x: number < x), ("maximum", lambda x: number > x), ("exclusiveMinimum", lambda x: number <= x), ("exclusiveMaximum", lambda x: number >= x), ("minItems", lambda x: F.when(array.isNotNull(), F.size(array) < x)), ("maxItems", lambda x: F.when(array.isNotNull(), F.size(array) > x))):
        if name in schema:
            check(bad(schema[name]), f"{name} {schema[name]}")
    if schema.get("required"):
        lacks = F.filter(F.array(*map(F.lit, schema["required"])), lambda n: ~F.map_contains_key(fields, n))
        parts.append(F.when(fields.isNotNull(), F.transform(lacks, lambda n: F.concat(path, F.lit("/"), n, F.lit(": required")))).otherwise(_none()))
    for name, own in schema.get("properties", {}).items():
        at = F.concat(path, F.lit(f"/{name}"))
        parts.append(F.coalesce(F.when(F.map_contains_key(fields, F.lit(name)), inner(F.element_at(fields, F.lit(name)), own, at)), _none()))
    if schema.get("additionalProperties", True) is not True:
        known = F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast(NONE)
        more = F.filter(F.map_keys(fields), lambda k: ~F.array_contains(known, k))
        if schema["additionalProperties"] is False:
            own = F.transform(F.sort_array(more), lambda k: F.concat(path, F.lit("/"), k, F.lit(": unknown property")))
        else:
            own = F.flatten(F.transform(F.sort_array(more), lambda k: inner(F.element_at(fields, k), schema["additionalProperties"], F.concat(path, F.lit("/"), k))))
        parts.append(F.coalesce(own, _none()))
    if "items" in schema:
        parts.append(F.coalesce(F.flatten(F.transform(array, lambda x, i: inner(x, schema["items"], F.concat(path, F.lit("/"), i.cast("string"))))), _none()))
    parts += [inner(value, s) for s in schema.get("allOf", [])]
    fits = lambda s: F.size(inner(value, s)) == 0
    if "anyOf" in schema:
        check(~F.array_contains(F.array(*map(fits, schema["anyOf"])), True), "anyOf")
    if "oneOf" in schema:
        check(sum((fits(s).cast("int") for s in schema["oneOf"]), F.lit(0)) != 1, "oneOf")
    if "not" in schema:
        check(fits(schema["not"]), "not")
    if "if" in schema:
        parts.append(F.when(fits(schema["if"]), inner(value, schema.get("then", True))).otherwise(inner(value, schema.get("else", True))))
    return _all(parts)


def faults(text: Column, schema: dict, depth: int = 16) -> Column:
    """Every fault of a JSON document, "path: rule", none for a valid one; what is no JSON (or null) has the fault "/: no JSON"."""
    return doc.let(doc.parsed(text), lambda v: F.when(v.isNotNull(), _faults(v, schema, F.lit(""), schema, depth)).otherwise(F.array(F.lit("/: no JSON"))))


def hold(df: DataFrame, body: str, schema: dict) -> tuple[DataFrame, DataFrame]:
    """(rows whose document is valid, the others with faults)."""
    out = df.withColumn("faults", faults(F.col(body), schema))
    return out.where(F.size("faults") == 0).drop("faults"), out.where(F.size("faults") > 0)
