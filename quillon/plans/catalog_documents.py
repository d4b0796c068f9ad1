"""Queries over JSON documents made of `events`. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import documents as doc
from quillon.operators import json_rules
from quillon.plans.catalog import query, read_table

#: The record type of an event's document.
EVENT_SCHEMA = {
    "type": "object", "required": ["type", "user", "value"], "additionalProperties": False,
    "properties": {
        "10": {"type": "integer", "minimum": 0}, "9": {"const": True}, "type": {"enum": ["click", "view", "purchase", "signup"]}, "user": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 4}, "value": {"type": "number", "exclusiveMinimum": 0, "maximum": 250}, "props": {"$ref": "#/$defs/props"},
        "tags": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 4}},
    },
    "if": {"properties": {"type": {"const": "purchase"}}}, "then": {"required": ["props"]},
    "$defs": {"props": {"type": "object", "additionalProperties": {"type": "integer", "maximum": 60}}},
}

BODY_SQL = """b AS (SELECT event_id, event_type, user_id, value, props, props IS NOT NULL AND event_id % 4 <> 0 AS has, event_id % 6 = 0 AS odd, value IS NOT NULL AND event_id % 9 <> 0 AS valued FROM events)"""


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """event_id and body: documents with their keys out of order, some fields left out and some odd ones.

    The table's file has few row groups, so few tasks would read it and do all that follows; its rows are dealt to four tasks a core."""
    k = F.col("event_id")
    e = read_table(spark, sf, "events").repartition(4 * max(spark.sparkContext.defaultParallelism, 2), k)
    value = F.when(F.col("value").isNotNull() & (k % 9 != 0), F.concat(F.lit('"value": '), F.col("value").cast("string"), F.lit(", "))).otherwise("")
    props = F.when(F.col("props").isNotNull() & (k % 4 != 0), F.concat(F.lit('"props": '), "props", F.lit(", "))).otherwise("")
    odd = F.when(k % 6 == 0, '"q\\"é": null, "tags": [], ').otherwise(F.concat(F.lit('"tags": [ "'), "event_type", F.lit('", "x"], ')))
    body = F.concat(F.lit("{"), value, odd, F.lit('"user": "u'), F.col("user_id").cast("string"), F.lit('", '), props, F.lit('"type": "'), "event_type", F.lit('", "10": '), k.cast("string"), F.lit(', "9": true}'))
    return e.select("event_id", F.when(k % 50 == 7, F.concat(body, F.lit("}"))).otherwise(body).alias("body"))


@query(f"""WITH {BODY_SQL}, t AS (SELECT event_id, CASE WHEN event_id % 50 <> 7 THEN '{{"9":true,"10":' || event_id || CASE WHEN has THEN ',"props":' || replace(props, ' ', '') ELSE '' END || CASE WHEN odd THEN ',"q\\"é":null,"tags":[]' ELSE ',"tags":["' || event_type || '","x"]' END || ',"type":"' || event_type || '","user":"u' || user_id || '"'
  || CASE WHEN valued THEN ',"value":' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END ELSE '' END || '}}' END AS body FROM b) SELECT event_id, body, sha256(body) AS digest FROM t""")
def canonical_documents(spark, sf):
    rows = bodies(spark, sf).select("event_id", doc.canonical_json(F.col("body"), depth=3).alias("body"))
    return rows.select("event_id", "body", F.sha2("body", 256).alias("digest"))


@query(f"""WITH {BODY_SQL} SELECT event_id, CASE WHEN event_id % 50 = 7 THEN '/: no JSON' ELSE concat_ws(';', CASE WHEN NOT valued THEN '/value: required' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN '/type: enum' END, CASE WHEN user_id > 999 THEN '/user: maxLength 4' END,
  CASE WHEN valued AND value > 250 THEN '/value: maximum 250' END, CASE WHEN valued AND value <= 0 THEN '/value: exclusiveMinimum 0' END, CASE WHEN has AND (props->>'k')::INT > 60 THEN '/props/k: maximum 60' END, CASE WHEN odd THEN '/tags: minItems 1' END, CASE WHEN NOT odd AND length(event_type) < 4 THEN '/tags/0: minLength 4' END, CASE WHEN NOT odd THEN '/tags/1: minLength 4' END,
  CASE WHEN odd THEN '/q"é: unknown property' END, CASE WHEN event_type = 'purchase' AND NOT has THEN '/props: required' END) END AS faults FROM b""")
def schema_faults(spark, sf):
    return bodies(spark, sf).select("event_id", F.array_join(json_rules.faults(F.col("body"), EVENT_SCHEMA), ";").alias("faults"))
