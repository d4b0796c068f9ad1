"""JSON documents of any shape as Column expressions over VARIANT: one canonical text for equal documents, and their values' types.

Both go down a document level by level within the row, without a shuffle and without Python. Canonical form: keys in order
(those that are array indices first, by number, then by UTF-16 code units), numbers as the shortest decimals of doubles, least
escapes. A document with a key twice, or that is no JSON, is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of arrays and objects that a document may have; deeper ones fail the query.
DEPTH = 10
#: Characters that are escaped by a letter.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

#: Fixed value: scalars that Spark writes as they are to be.
AS_WRITTEN = r"^(?:true|false|null|0|-?(?:[1-9][0-9]{0,14}|(?:0|[1-9][0-9]{0,8})\.[0-9]{0,5}[1-9]))$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def parsed(text: Column) -> Column:
    """The document as VARIANT; null where the text is not one JSON value and nothing else.

    Spark's parser does not look at what follows a value. Inside brackets and inside an object it has to: what follows must
    then close both, so it is nothing."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(listed, lambda one: F.when((F.size(as_array(one)) == 1) & named.isNotNull(), F.try_variant_get(one, "$[0]", "variant")))


def quoted(text: Column) -> Column:
    """A JSON string."""
    escapes = SHORT | {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in SHORT}
    pairs = F.array(*[F.array(F.lit(c), F.lit(e)) for c, e in escapes.items()])
    odd = F.aggregate(pairs, text, lambda t, p: F.replace(t, p[0], p[1]))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), odd).otherwise(text), F.lit('"'))


def _decimal(number: Column) -> Column:
    """A number of up to 15 digits, or of a double (1.5E-7), in its shortest form."""
    sign = F.when(number.startswith("-"), "-").otherwise("")
    whole, part = F.regexp_extract(number, r"^-?(\d+)", 1), F.regexp_extract(number, r"\.(\d+)", 1)
    power = F.coalesce(F.regexp_extract(number, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))

    def written(s: Column) -> Column:
        digits, k, n = s["digits"], F.length(s["digits"]), s["point"]
        first, rest = F.substring(digits, 1, 1), digits.substr(F.lit(2), k)
        exponent = F.concat(first, F.when(k > 1, F.concat(F.lit("."), rest)).otherwise(""), F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
        return (
            F.when(k == 0, "0")
            .when((n >= k) & (n <= 21), F.concat(s["sign"], F.rpad(digits, n, F.lit("0"))))
            .when((n > 0) & (n <= 21), F.concat(s["sign"], digits.substr(F.lit(1), n), F.lit("."), digits.substr(n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(s["sign"], F.lit("0."), F.repeat(F.lit("0"), -n), digits))
            .otherwise(F.concat(s["sign"], exponent))
        )

    raw = F.concat(whole, part)
    led = F.regexp_replace(raw, "^0+", "")
    parts = F.struct(sign.alias("sign"), F.regexp_replace(led, "0+$", "").alias("digits"), (F.length(whole) + power - (F.length(raw) - F.length(led))).alias("point"))
    return let(parts, written)


def number_text(value: Column) -> Column:
    """The text of a VARIANT number; null where it is beyond all doubles."""
    plain = F.to_json(value)
    double = F.try_variant_get(value, "$", "double")
    exact = plain.rlike(r"^-?[0-9.]{1,16}$") & (F.length(F.regexp_replace(plain, r"[-.]", "")) <= 15)
    return F.when(F.isnan(double) | (F.abs(double) == float("inf")), "null").otherwise(_decimal(F.when(exact, plain).otherwise(double.cast("string"))))


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_string(value: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(F.to_json(value).startswith('"'), F.try_variant_get(value, "$", "string"))


def type_of(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    plain = F.to_json(value)
    return (
        F.when(F.is_variant_null(value), "null").when(as_map(value).isNotNull(), "object").when(as_array(value).isNotNull(), "array")
        .when(plain.startswith('"') & ~plain.isin('"Infinity"', '"-Infinity"'), "string").when(plain.isin("true", "false"), "boolean").otherwise("number")
    )


def _scalar(value: Column) -> Column:
    """The text of a value that is no array or object. Spark's own text is the canonical one for most: strings without escapes,
    and numbers of up to 15 digits that have no zeros to drop and no exponent. Others are written anew."""
    kind = type_of(value)
    anew = F.when(kind == "string", quoted(F.try_variant_get(value, "$", "string"))).when(kind == "number", number_text(value)).when(kind == "null", "null").otherwise(F.to_json(value))
    same = lambda t: F.when(t.startswith('"'), ~t.contains("\\") & ~t.isin('"Infinity"', '"-Infinity"')).otherwise(t.rlike(AS_WRITTEN))
    return let(F.to_json(value), lambda t: F.when(same(t), t).otherwise(anew))


def _places(keys: Column) -> Column:
    """Keys of an object in the order in which they are written, each with its place `at` among the given ones."""
    index = lambda k: F.when(k.rlike("^(0|[1-9][0-9]{0,9})$"), k.try_cast("bigint"))
    place = lambda k, at: F.struct(F.coalesce(F.least(index(k), F.lit(2**32 - 1)), F.lit(2**32 - 1)).alias("index"), F.encode(k, "UTF-16BE").alias("units"), k.alias("key"), at.alias("at"))
    return F.sort_array(F.transform(keys, place))


def in_order(keys: Column) -> Column:
    """Keys of an object in the order in which they are written."""
    return F.transform(_places(keys), lambda s: s["key"])


def _written(value: Column, level: int, indent: int | None, depth: int) -> Column:
    if level == depth:
        deeper = as_map(value).isNotNull() | as_array(value).isNotNull()
        return F.when(deeper, F.raise_error(F.lit(f"a document has more than {depth} levels")).cast("string")).otherwise(_scalar(value))
    gap, colon = ("", ":") if indent is None else ("\n" + " " * indent * (level + 1), ": ")
    end = "" if indent is None else "\n" + " " * indent * level

    def shaped(s: Column) -> Column:
        held, items = s["held"], s["items"]
        fields = F.transform(_places(F.map_keys(held)), lambda k: F.struct(F.concat(quoted(k["key"]), F.lit(colon)).alias("name"), F.map_values(held)[k["at"]].alias("value")))
        plain = F.transform(items, lambda x: F.struct(F.lit("").alias("name"), x.alias("value")))
        texts = F.transform(F.coalesce(fields, plain), lambda x: F.concat(x["name"], _written(x["value"], level + 1, indent, depth)))
        left, right = (F.when(held.isNotNull(), a).otherwise(b) for a, b in (("{", "["), ("}", "]")))
        whole = F.concat(left, F.lit(gap), F.array_join(texts, f",{gap}"), F.lit(end), right)
        return F.when(F.coalesce(F.size(held), F.size(items)) > 0, whole).when(held.isNotNull(), "{}").when(items.isNotNull(), "[]").otherwise(_scalar(value))

    # both are taken out once: within a lambda nothing is computed in common
    return let(F.struct(as_map(value).alias("held"), as_array(value).alias("items")), shaped)


def canonical_json(text: Column, indent: int | None = None, depth: int = DEPTH) -> Column:
    """The canonical text of a JSON document: compact, or with an indent and a newline at the end."""
    tail = "" if indent is None else "\n"
    return let(parsed(text), lambda v: F.when(v.isNotNull(), F.concat(_written(v, 0, indent, depth), F.lit(tail))))


def document_digest(text: Column, without: str | None = None, depth: int = DEPTH) -> Column:
    """SHA-256 of the canonical text, of an object without one of its fields (such as that which holds the digest)."""
    value = parsed(text)
    if without is not None:
        left = lambda m: F.to_variant_object(F.map_filter(m, lambda k, _: k != without))
        value = let(value, lambda v: let(as_map(v), lambda m: F.when(m.isNotNull(), left(m)).otherwise(v)))
    return let(value, lambda v: F.when(v.isNotNull(), F.sha2(_written(v, 0, None, depth), 256)))
