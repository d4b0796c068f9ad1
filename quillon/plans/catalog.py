"""The named queries over the reference operators, each with oracle SQL for the same tables.

Three readings of the driver tables give the operators their input: `embeddings` as 8 x 8 rasters, `events` as ledgers of
users, and `part` as scored sources of brands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as sc
from quillon.operators import evidence as ev
from quillon.operators import fitting, gates, imaging, ledger, profiles
from quillon.operators import pixels as px
from quillon.operators import stats
from quillon.session import read_table, shared_folder
from quillon.streaming import ledgers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "envelope_region"


def query(sql: str | None = None):
    """Registers a function as a query under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ---- the three readings

PIXELS_SQL = """px AS (
  SELECT vec_id AS frame_id, label AS grp, i AS pos, (i // 8)::INT AS y, (i % 8)::INT AS x, 0.5::DOUBLE + embedding[i + 1]::DOUBLE AS v
  FROM embeddings, range(64) t(i))"""
LEDGER_SQL = """ledger AS (
  SELECT user_id, event_id, ts, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events)"""
SOURCES_SQL = """sources AS (
  SELECT p_partkey AS source_id, p_brand AS bundle, p_type AS seller, p_size AS useful_angles, (p_size * 40)::DOUBLE AS short_side,
    least(greatest((p_retailprice::DOUBLE - 900.0::DOUBLE) / 1200.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS variant_confidence,
    (['raw', 'sleeved', 'toploader', 'slabbed', 'unknown'])[p_partkey % 5 + 1] AS protection,
    (['none', 'low', 'medium', 'high', 'unknown'])[p_partkey % 7 % 5 + 1] AS lighting,
    (['low', 'medium', 'high', 'unknown'])[p_partkey % 4 + 1] AS compression,
    (['low', 'medium', 'high', 'unknown'])[p_partkey % 9 % 4 + 1] AS editing,
    (['low', 'medium', 'high'])[p_partkey % 3 + 1] AS proxy,
    CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'jp' END AS language, p_partkey % 4 = 1 AS macro
  FROM part)"""


def raster_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return px.explode_rasters(read_table(spark, sf, "embeddings"), "vec_id", "label", "embedding", 8)


def user_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ledger(read_table(spark, sf, "events"), "user_id", "ts", "event_id")


def brand_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    return read_table(spark, sf, "part").select(
        k.alias("source_id"),
        F.col("p_brand").alias("bundle"),
        F.col("p_type").alias("seller"),
        F.col("p_size").alias("useful_angles"),
        (F.col("p_size") * 40).cast("double").alias("short_side"),
        sc.clamp((F.col("p_retailprice") - 900.0) / 1200.0, 0, 1).alias("variant_confidence"),
        pick(ev.VISIBILITY, k % 5).alias("protection"),
        pick(ev.LIGHTING, k % 7 % 5).alias("lighting"),
        pick(ev.COMPRESSION, k % 4).alias("compression"),
        pick(ev.EDITING, k % 9 % 4).alias("editing"),
        pick(ev.PROXY, k % 3).alias("proxy"),
        F.when(k % 2 == 0, "en").otherwise("jp").alias("language"),
        (k % 4 == 1).alias("macro"),
    )


# ---- robust and circular statistics

@query(f"""WITH {PIXELS_SQL} SELECT grp, pos, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 6) AS span, round(var_pop(v), 6) AS variance, round(median(v), 6) AS med
FROM px GROUP BY grp, pos""")
def sequence_measure(spark, sf):
    return px.measure_sequence(raster_pixels(spark, sf)).select("grp", "pos", r6("span", "span"), r6("variance", "variance"), r6("med", "med"))


@query(f"WITH {PIXELS_SQL} SELECT grp, pos, frame_id AS peak_frame FROM px QUALIFY row_number() OVER (PARTITION BY grp, pos ORDER BY v DESC, frame_id) = 1")
def peak_frame(spark, sf):
    return px.peak_frame(raster_pixels(spark, sf)).select("grp", "pos", "peak_frame")


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med, count(*) AS n FROM lineitem GROUP BY 1),
d AS (SELECT l.l_suppkey, l_orderkey, l_linenumber, abs(l_extendedprice - med) AS dev, n FROM lineitem l JOIN m USING (l_suppkey)),
s AS (SELECT l_suppkey, median(dev) AS mad FROM d GROUP BY 1)
SELECT d.l_suppkey, count(*) AS n, count(*) FILTER (n >= 3 AND 0.6745 * dev / greatest(mad, 1e-4) > 2.0) AS outliers, round(max(0.6745 * dev / greatest(mad, 1e-4)), 6) AS worst
FROM d JOIN s USING (l_suppkey) GROUP BY 1""")
def modified_z_suppliers(spark, sf):
    rows = stats.modified_z(read_table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", limit=2.0)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if("outlier").alias("outliers"), r6(F.max("z"), "worst"))


@query("""WITH v AS (SELECT l_suppkey, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM v)
SELECT l_suppkey, min(x) AS weighted_median FROM c WHERE c >= 0.5 * t - 1e-9 GROUP BY 1""")
def weighted_step_median(spark, sf):
    return stats.weighted_step_quantile(read_table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.5, "weighted_median")


@query("""WITH a AS (SELECT event_type, radians(15.0::DOUBLE * hour(ts)) AS a, coalesce(value, 0) + 1 AS w FROM events),
s AS (SELECT event_type, sum(w * sin(a)) AS s, sum(w * cos(a)) AS c, sum(w) AS w FROM a GROUP BY 1)
SELECT event_type, round(((degrees(atan2(s, c)) % 360 + 360) % 360) / 15, 6) AS mean_hour, round(sqrt(s * s + c * c) / w, 6) AS resultant FROM s""")
def circular_hour_by_type(spark, sf):
    rows = read_table(spark, sf, "events").withColumn("w", F.coalesce("value", F.lit(0.0)) + 1)
    got = stats.circular_mean(rows, ["event_type"], F.hour("ts").cast("double"), F.col("w"), period=24.0)
    return got.select("event_type", r6("mean_angle", "mean_hour"), r6("resultant", "resultant"))


@query("""WITH a AS (SELECT l_returnflag AS flag, radians(dayofyear(l_shipdate)::DOUBLE) AS a, radians(l_quantity * 7.0::DOUBLE) AS b FROM lineitem),
m AS (SELECT flag, atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM a GROUP BY 1),
d AS (SELECT flag, sin(a - ma) AS x, sin(b - mb) AS y FROM a JOIN m USING (flag))
SELECT flag, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS rho FROM d GROUP BY 1""")
def circular_correlation(spark, sf):
    rows = read_table(spark, sf, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return stats.circular_correlation(rows, ["flag"], F.radians(F.dayofyear("l_shipdate").cast("double")), F.radians(F.col("l_quantity") * 7.0)).select("flag", r6("rho", "rho"))


@query("""WITH m AS (SELECT l_orderkey, median(l_discount) AS med, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
SELECT l_orderkey, round(max(abs(l_discount - med)), 6) AS max_deviation, count(*) FILTER (round(abs(l_discount - med), 9) > 0.035) AS outliers FROM lineitem JOIN m USING (l_orderkey) GROUP BY 1""")
def group_exposure_gate(spark, sf):
    return stats.exposure_gate(read_table(spark, sf, "lineitem"), "l_orderkey", "l_discount", 0.035).select("l_orderkey", r6("max_deviation", "max_deviation"), "outliers")


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - a) / (b - a), 0), 1), 6) AS v FROM lineitem, q""")
def robust_normalize(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return stats.robust_normalize(rows, "l_extendedprice", "v").select("l_orderkey", "l_linenumber", r6("v", "v"))


# ---- gates and constraints

NEEDS = [("click", 7, []), ("refund", 1, []), ("view", 7, []), ("stream", 3, ["view"]), ("purchase", 5, [])]


@query("""WITH need AS (SELECT * FROM (VALUES ('click', 7, NULL), ('refund', 1, NULL), ('view', 7, NULL), ('stream', 3, 'view'), ('purchase', 5, NULL)) t(kind, least, alt)),
c AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1)
SELECT kind, least, coalesce(n, 0) AS n FROM need LEFT JOIN c USING (kind) WHERE coalesce(n, 0) < least AND (alt IS NULL OR alt NOT IN (SELECT kind FROM c))""")
def completeness(spark, sf):
    return gates.completeness(read_table(spark, sf, "events"), "event_type", NEEDS)


@query("""SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN n_chars > 8000 THEN 'long' END,
 CASE WHEN length(regexp_replace(text, '[^A-Z]', '', 'g')) > 0.3 * length(text) THEN 'shouting' END, CASE WHEN text NOT LIKE '%.%' THEN 'no sentence' END) AS reasons FROM documents""")
def frame_quality_reasons(spark, sf):
    t = F.col("text")
    rules = [(F.length(t) < 200, "short"), (F.col("n_chars") > 8000, "long"), (F.length(F.regexp_replace(t, "[^A-Z]", "")) > 0.3 * F.length(t), "shouting"), (~F.contains(t, F.lit(".")), "no sentence")]
    return gates.gate(read_table(spark, sf, "documents"), rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedup(spark, sf):
    return gates.duplicates(read_table(spark, sf, "documents"), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def integrity_anti(spark, sf):
    return gates.missing(read_table(spark, sf, "documents").select("doc_id"), read_table(spark, sf, "labels"), "doc_id")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p, url FROM pages)
SELECT page_id, NOT (contains(p, '\') OR contains(p, '://') OR starts_with(p, '/') OR starts_with(p, '~') OR ends_with(p, '/') OR p = '' OR list_contains(string_split(p, '/'), '..')) AS safe,
 CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'scheme' ELSE NULL END AS reason,
 CASE WHEN regexp_matches(url, '\.[A-Za-z0-9]{1,8}$') THEN lower(regexp_extract(url, '(\.[A-Za-z0-9]{1,8})$', 1)) ELSE '.bin' END AS ext FROM p""")
def safe_path(spark, sf):
    p = F.regexp_replace("url", "^https?://", "")
    return read_table(spark, sf, "pages").select("page_id", sc.safe_relative_path(p).alias("safe"), sc.asset_uri_reason(F.col("url")).alias("reason"), sc.safe_extension(F.col("url")).alias("ext"))


VOCABULARY = ("license", "copyright", "password", "token", "licensed")


@query(r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), '\blicense\b') THEN 'license' END, CASE WHEN regexp_matches(lower(text), '\bcopyright\b') THEN 'copyright' END,
 CASE WHEN regexp_matches(lower(text), '\bpassword\b') THEN 'password' END, CASE WHEN regexp_matches(lower(text), '\btoken\b') THEN 'token' END, CASE WHEN regexp_matches(lower(text), '\blicensed\b') THEN 'licensed' END) AS words
FROM documents WHERE regexp_matches(lower(text), '\b(license|copyright|password|token|licensed)\b')""")
def vocabulary_gate(spark, sf):
    found = read_table(spark, sf, "documents").withColumn("found", sc.words_in(F.col("text"), VOCABULARY))
    return found.where(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("words"))


@query("""SELECT 'click' AS event_type, (SELECT count(*) FROM events WHERE event_type = 'click') AS n UNION ALL SELECT 'refund', (SELECT count(*) FROM events WHERE event_type = 'refund')
UNION ALL SELECT 'view', (SELECT count(*) FROM events WHERE event_type = 'view')""")
def domain_zero_fill(spark, sf):
    return stats.domain_counts(read_table(spark, sf, "events"), "event_type", ["click", "refund", "view"])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'too small' WHEN o_orderstatus NOT IN ('O', 'F', 'P') THEN 'status' WHEN o_orderpriority LIKE '%URGENT%' AND o_totalprice > 200000 THEN 'urgent and large' END AS violation FROM orders""")
def first_violation(spark, sf):
    rules = [(F.col("o_totalprice") < 1000, "too small"), (~F.col("o_orderstatus").isin("O", "F", "P"), "status"), (F.contains("o_orderpriority", F.lit("URGENT")) & (F.col("o_totalprice") > 200000), "urgent and large")]
    return read_table(spark, sf, "orders").select("o_orderkey", gates.first_violation(rules).alias("violation"))


@query("""WITH k AS (SELECT event_id, coalesce(list_sort(json_keys(props)), []) AS keys FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains(['k'], x))), ',') AS unknown, array_to_string(list_sort(list_filter(['k', 'version'], lambda x: NOT list_contains(keys, x))), ',') AS missing FROM k""")
def attestation_keys(spark, sf):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    unknown, missing = profiles.key_differences(keys, ["k"], ["k", "version"])
    return read_table(spark, sf, "events").select("event_id", F.array_join(unknown, ",").alias("unknown"), F.array_join(missing, ",").alias("missing"))


# ---- evidence

COMPONENTS_SQL = SOURCES_SQL + """, comp AS (SELECT *, CASE WHEN language = 'en' THEN 1.0::DOUBLE ELSE 0 END AS english,
  MAP {'raw': 1.0, 'sleeved': 0.7, 'toploader': 0.5, 'slabbed': 0.35, 'unknown': 0.4}[protection]::DOUBLE AS vis, least(useful_angles / 5.0::DOUBLE, 1) AS ang,
  CASE WHEN macro THEN 1.0::DOUBLE ELSE 0 END AS mac, MAP {'none': 0.0, 'low': 0.35, 'medium': 0.7, 'high': 1.0, 'unknown': 0.25}[lighting]::DOUBLE AS lit, least(short_side / 1200.0::DOUBLE, 1) AS res,
  MAP {'low': 0.0, 'medium': 0.4, 'high': 0.8, 'unknown': 0.5}[compression]::DOUBLE AS pc, MAP {'low': 0.0, 'medium': 0.5, 'high': 1.0, 'unknown': 0.6}[editing]::DOUBLE AS pe,
  MAP {'low': 0.0, 'medium': 0.5, 'high': 1.0}[proxy]::DOUBLE AS pp FROM sources),
scored AS (SELECT *, least(greatest(0.22 * variant_confidence + 0.1 * english + 0.14 * vis + 0.1 * ang + 0.08 * mac + 0.08 * lit + 0.1 * res + 0.18 * 0.9 - 0.3 * pc - 0.35 * pe - 0.5 * pp, 0), 1)::DOUBLE AS raw, round(raw::DECIMAL(12, 9), 4)::DOUBLE AS score FROM comp),
tiered AS (SELECT *, CASE WHEN score >= 0.55 AND variant_confidence >= 0.5 AND pp = 0 THEN 'A' WHEN score >= 0.35 AND variant_confidence >= 0.3 AND pp < 1 THEN 'B' ELSE 'C' END AS tier FROM scored)"""


def scored_sources(spark: SparkSession, sf: str) -> DataFrame:
    return ev.source_components(brand_sources(spark, sf), F.lit(0.9)).withColumn("score", ev.composite())


def tiered_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers with the thresholds lowered to what the driver's parts can reach."""
    s, v, p = F.col("score"), F.col("variant_confidence"), F.col("proxy_risk_penalty")
    tier = F.when((s >= 0.55) & (v >= 0.5) & (p == 0), "A").when((s >= 0.35) & (v >= 0.3) & (p < 1), "B").otherwise("C")
    return scored_sources(spark, sf).withColumn("tier", tier)


@query(f"WITH {COMPONENTS_SQL} SELECT source_id, round(score, 6) AS score FROM scored")
def source_score(spark, sf):
    return scored_sources(spark, sf).select("source_id", r6("score", "score"))


@query(f"""WITH {COMPONENTS_SQL} SELECT source_id, CASE WHEN score >= 0.75 AND variant_confidence >= 0.9 AND pp = 0 THEN 'A' WHEN score >= 0.5 AND variant_confidence >= 0.6 AND pp < 1 THEN 'B' ELSE 'C' END AS tier FROM scored""")
def source_tier(spark, sf):
    tier = ev.source_tier(F.col("score"), F.col("variant_confidence"), F.col("proxy_risk_penalty"), F.lit(True))
    return scored_sources(spark, sf).select("source_id", tier.alias("tier"))


@query(f"""WITH {COMPONENTS_SQL}, c AS (SELECT bundle, count(*) FILTER (tier = 'A') AS n_a, count(*) FILTER (tier = 'B') AS n_b FROM tiered GROUP BY 1)
SELECT bundle, n_a, n_b, CASE WHEN n_a >= 2 THEN 'A' WHEN n_a >= 1 OR n_a + n_b >= 2 THEN 'B' ELSE 'C' END AS bundle_tier, n_a >= 2 AS eligible FROM c""")
def bundle_tier(spark, sf):
    return ev.bundle_tiers(tiered_sources(spark, sf), "bundle", "tier")


@query(f"""WITH {SOURCES_SQL}, rep AS (SELECT bundle, seller FROM sources GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT s.*, CASE WHEN protection = 'unknown' THEN 'unknown' ELSE 'seller:' || lower(trim(s.seller)) END AS family, rep.seller IS NOT NULL AS repeats, CASE WHEN useful_angles % 3 = 0 THEN NULL ELSE useful_angles END AS angle FROM sources s LEFT JOIN rep ON s.bundle = rep.bundle AND s.seller = rep.seller),
a AS (SELECT bundle, max(CASE WHEN source_id % 6 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS t, least((count(DISTINCT angle) + max(CASE WHEN angle IS NULL THEN 1 ELSE 0 END)) / 3.0::DOUBLE, 1) AS g,
 avg(CASE WHEN lighting IN ('medium', 'high') THEN 1.0::DOUBLE ELSE 0 END) * CASE WHEN bool_or(repeats) THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS l, max(CASE WHEN macro THEN 1.0::DOUBLE ELSE 0 END) AS m,
 least(count(DISTINCT family) / 3.0::DOUBLE, 1) AS i, (min(variant_confidence) + median(variant_confidence)) / 2 AS v, CASE WHEN bool_or(proxy = 'high') AND NOT bool_and(proxy = 'high') THEN 1.0::DOUBLE WHEN bool_or(proxy = 'high') THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS d FROM s GROUP BY 1)
SELECT bundle, round(0.1::DOUBLE * t + 0.2::DOUBLE * g + 0.15::DOUBLE * l + 0.1::DOUBLE * m + 0.15::DOUBLE * i + 0.2::DOUBLE * v + 0.1::DOUBLE * d, 6) AS coverage, round(l, 6) AS lighting_consistency, round(v, 6) AS variant_confidence FROM a""")
def bundle_coverage(spark, sf):
    s = brand_sources(spark, sf)
    repeats = s.groupBy("bundle", "seller").count().select("bundle", "seller", (F.col("count") >= 2).alias("seller_repeats"))
    rows = s.join(repeats, ["bundle", "seller"]).withColumns(
        {
            "media_form": F.when(F.col("source_id") % 6 == 0, "video").otherwise("photo"),
            "angle": F.when(F.col("useful_angles") % 3 != 0, F.col("useful_angles")),
            "family": ev.family_key(F.when(F.col("protection") == "unknown", "provenance unknown"), F.col("seller"), F.lit("")),
            "flagged": F.col("proxy") == "high",
        }
    )
    return ev.coverage(rows, "bundle").select("bundle", r6("coverage", "coverage"), r6("lighting_consistency", "lighting_consistency"), r6("variant_confidence", "variant_confidence"))


@query("SELECT p_brand, count(DISTINCT CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END) + max(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) AS n FROM part GROUP BY 1")
def distinct_with_null_bucket(spark, sf):
    return read_table(spark, sf, "part").groupBy("p_brand").agg(stats.distinct_with_null(F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).alias("n"))


@query("""SELECT doc_id, CASE WHEN source = 'src0' THEN 'unknown' WHEN trim(lang) <> '' THEN 'seller:' || lower(trim(source)) ELSE 'listing:' || doc_id END AS family FROM documents""")
def provenance_family(spark, sf):
    notes = F.when(F.col("source") == "src0", "Provenance unknown; scan")
    return read_table(spark, sf, "documents").select("doc_id", ev.family_key(notes, F.col("source"), F.col("doc_id").cast("string")).alias("family"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS cards, count(DISTINCT l_orderkey) AS sessions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2 AND count(DISTINCT l_orderkey) >= 2")
def family_two_card_rule(spark, sf):
    return ev.families_with_two(read_table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey")


@query(f"""WITH {PIXELS_SQL}, e AS (SELECT grp, frame_id, abs(avg(v) - 0.5) AS e FROM px GROUP BY 1, 2),
s AS (SELECT grp, count(*) AS n, avg(exp(-e / 0.06)) AS a, max(exp(-e / 0.06)) / sum(exp(-e / 0.06)) AS share FROM e GROUP BY 1)
SELECT grp, n, round(a * (1 - 0.5 * CASE WHEN n > 1 THEN (share - 1.0::DOUBLE / n) / (1 - 1.0::DOUBLE / n) ELSE 1 END), 6) AS consistency FROM s""")
def consistency_score(spark, sf):
    errors = raster_pixels(spark, sf).groupBy("grp", "frame_id").agg(F.abs(F.avg("v") - 0.5).alias("e"))
    return ev.consistency(errors, "grp", "e").select("grp", "n", r6("consistency", "consistency"))


# ---- ledgers

@query("""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
SELECT conv_id, count(*) AS turns, max(turn) AS last, min(place) FILTER (turn <> place) AS expected, min(turn) FILTER (turn <> place) AS found FROM p GROUP BY 1""")
def turn_sequences(spark, sf):
    """Every conversation with its number of turns and the first that is not in its place (null: all are)."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn")
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"))
    return whole.join(ledger.sequence_breaks(turns, "conv_id", "turn"), "conv_id", "left").select("conv_id", "turns", "last", "expected", "found")


@query(f"WITH {LEDGER_SQL}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, sequence FROM ledger) SELECT user_id, count(*) AS events, min(place) FILTER (sequence <> place) AS expected, count(*) FILTER (sequence <> place) AS moved FROM k GROUP BY 1")
def ledger_order_check(spark, sf):
    """Whether each user's events come in the order of their ids: events, the first place with another one, how many are elsewhere."""
    own = user_ledger(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    off = F.col("sequence") != F.col("place")
    return own.groupBy("user_id").agg(F.count("*").alias("events"), F.min(F.when(off, F.col("place"))).alias("expected"), F.count_if(off).alias("moved"))


@query(f"""WITH {LEDGER_SQL}, d AS (SELECT user_id, event_id, sequence, sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}}') AS digest FROM ledger)
SELECT event_id, sequence, digest, lag(digest) OVER (PARTITION BY user_id ORDER BY sequence) AS previous_digest FROM d""")
def ledger_hash_payload(spark, sf):
    fields = [F.col(c) for c in ("event_id", "event_type", "user_id")]
    return ledger.chain(user_ledger(spark, sf), "user_id", "sequence", fields).select("event_id", F.col("sequence").cast("long").alias("sequence"), "digest", "previous_digest")


@query(f"WITH {LEDGER_SQL}, l AS (SELECT user_id, max(sequence) AS last FROM ledger WHERE event_type = 'error' GROUP BY 1) SELECT event_id FROM ledger LEFT JOIN l USING (user_id) WHERE event_type = 'purchase' AND (last IS NULL OR sequence > last)")
def approval_invalidation(spark, sf):
    e = F.col("event_type")
    return ledger.standing_approvals(user_ledger(spark, sf), "user_id", "sequence", e == "purchase", e == "error").select("event_id")


@query(f"WITH {LEDGER_SQL} SELECT user_id, arg_max(event_type, sequence) AS state, count(*) AS events FROM ledger GROUP BY 1")
def current_state(spark, sf):
    return ledger.current_state(user_ledger(spark, sf), "user_id", "sequence", "event_type")


@query(f"""WITH {LEDGER_SQL}, m AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS comments, count(*) FILTER (event_type = 'view') AS resolved, max(sequence) FILTER (event_type = 'error') AS reg, max(sequence) FILTER (event_type IN ('signup', 'purchase')) AS app FROM ledger GROUP BY 1),
h AS (SELECT l.user_id, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'purchase') AS p FROM ledger l JOIN m USING (user_id) WHERE reg IS NULL OR sequence > reg GROUP BY 1)
SELECT user_id, CASE WHEN comments > resolved OR coalesce(reg > coalesce(app, -1), false) THEN 'needs-revision' WHEN s AND p THEN 'rights-approved' WHEN s THEN 'technically-approved' ELSE 'unreviewed' END AS state FROM m LEFT JOIN h USING (user_id)""")
def review_state_ladder(spark, sf):
    ladder = [("signup", "technically-approved"), ("purchase", "rights-approved")]
    return ledger.review_ladder(user_ledger(spark, sf), "user_id", "sequence", "event_type", "click", "view", ladder, "error").select("user_id", "state")


@query(f"""WITH {LEDGER_SQL}, r AS (SELECT *, MAP {{'signup': 0, 'view': 1, 'click': 2, 'purchase': 3, 'error': 4}}[event_type] AS k FROM ledger),
s AS (SELECT user_id, sequence, k, event_type, lag(event_type) OVER w AS from_state, lag(k) OVER w AS f FROM r WINDOW w AS (PARTITION BY user_id ORDER BY sequence))
SELECT user_id, sequence, from_state, event_type AS to_state FROM s WHERE k > coalesce(f, -1) + 1""")
def transition_violations(spark, sf):
    got = ledger.transition_violations(user_ledger(spark, sf), "user_id", "sequence", "event_type", ["signup", "view", "click", "purchase", "error"])
    return got.withColumn("sequence", F.col("sequence").cast("long"))


@query(f"WITH {LEDGER_SQL} SELECT user_id, event_type AS name, arg_max(value, sequence) FILTER (value IS NOT NULL) AS value FROM ledger WHERE value IS NOT NULL GROUP BY 1, 2")
def revision_fingerprint(spark, sf):
    return ledger.fingerprints(user_ledger(spark, sf), "user_id", "sequence", F.col("event_type"), F.col("value"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) = 1")
def nulls_last_first(spark, sf):
    order = Window.partitionBy("user_id").orderBy(F.col("value").asc_nulls_last(), "event_id")
    return read_table(spark, sf, "events").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("user_id", "event_id")


# ---- pixels

ACTIVE_SQL = PIXELS_SQL + ", top AS (SELECT frame_id, quantile_cont(v, 0.99) AS top FROM px GROUP BY 1), act AS (SELECT frame_id, grp, pos FROM px JOIN top USING (frame_id) WHERE top > 0.02 AND v >= 0.75 * top)"


@query(f"""WITH {ACTIVE_SQL}, p AS (SELECT frame_id AS f, lead(frame_id) OVER (PARTITION BY grp ORDER BY frame_id) AS g FROM (SELECT DISTINCT frame_id, grp FROM px)),
n AS (SELECT frame_id, count(*) AS n FROM act GROUP BY 1), s AS (SELECT f, g, count(*) AS common FROM p JOIN act a ON a.frame_id = f JOIN act b ON b.frame_id = g AND a.pos = b.pos GROUP BY 1, 2)
SELECT p.f, p.g, round(coalesce(common, 0)::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(common, 0)), 6) AS iou FROM p LEFT JOIN s ON s.f = p.f AND s.g = p.g LEFT JOIN n x ON x.frame_id = p.f LEFT JOIN n y ON y.frame_id = p.g WHERE p.g IS NOT NULL""")
def activation_iou(spark, sf):
    p = raster_pixels(spark, sf)
    frames = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("grp"))
    return px.mask_iou(px.activation(p, share=0.75), px.next_frames(frames)).select("f", "g", r6("iou", "iou"))


@query(f"WITH {PIXELS_SQL}, c AS (SELECT frame_id, CASE WHEN y < 2 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END AS cy, CASE WHEN x < 2 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END AS cx, v FROM px) SELECT frame_id, cy, cx, round(avg(v), 6) AS mean FROM c GROUP BY 1, 2, 3")
def grid_regions(spark, sf):
    cells = raster_pixels(spark, sf).withColumn("cy", px.grid_cell(F.col("y"), 8)).withColumn("cx", px.grid_cell(F.col("x"), 8))
    return cells.groupBy("frame_id", "cy", "cx").agg(r6(F.avg("v"), "mean"))


CENTROID_SQL = PIXELS_SQL + """, q AS (SELECT frame_id, grp, quantile_cont(v, 0.96) AS top, count(*) AS size FROM px GROUP BY 1, 2), h AS (SELECT px.frame_id, px.grp, x, y, size, greatest(v - top, 1e-6) AS w FROM px JOIN q USING (frame_id) WHERE v >= top),
cen AS (SELECT frame_id, grp, count(*) AS n, CASE WHEN max(size) >= 4 THEN sum(w * x) / sum(w) END AS cx, CASE WHEN max(size) >= 4 THEN sum(w * y) / sum(w) END AS cy FROM h GROUP BY 1, 2)"""


@query(f"WITH {CENTROID_SQL} SELECT frame_id, n, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cen")
def highlight_centroid(spark, sf):
    return px.highlight_centroid(raster_pixels(spark, sf)).select("frame_id", "n", r6("cx", "cx"), r6("cy", "cy"))


@query(f"""WITH {CENTROID_SQL}, s AS (SELECT grp, frame_id, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy FROM cen WINDOW w AS (PARTITION BY grp ORDER BY frame_id)),
t AS (SELECT grp, dx, dy, sqrt(dx * dx + dy * dy) AS len, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM s WINDOW w AS (PARTITION BY grp ORDER BY frame_id)), u AS (SELECT *, sqrt(px * px + py * py) AS plen FROM t)
SELECT grp, count(len) AS steps, round(avg(len), 6) AS mean_step, round(avg(CASE WHEN len > 1e-6 AND plen > 1e-6 THEN (1 + (dx * px + dy * py) / (len * plen)) / 2 END), 6) AS turn FROM u GROUP BY 1""")
def trajectory_coherence(spark, sf):
    return px.trajectory_coherence(px.highlight_centroid(raster_pixels(spark, sf))).select("grp", "steps", r6("mean_step", "mean_step"), r6("turn", "turn"))


GRAD_SQL = PIXELS_SQL + """, g AS (SELECT frame_id, pos, y, x, (lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) - lag(v) OVER (PARTITION BY frame_id, y ORDER BY x)) / 2 AS gx, (lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) - lag(v) OVER (PARTITION BY frame_id, x ORDER BY y)) / 2 AS gy FROM px)"""


@query(f"WITH {GRAD_SQL} SELECT frame_id, pos, round(gx, 6) AS gx, round(gy, 6) AS gy, round(sqrt(gx * gx + gy * gy), 6) AS magnitude FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL")
def gradient(spark, sf):
    return px.gradient(raster_pixels(spark, sf)).select("frame_id", "pos", r6("gx", "gx"), r6("gy", "gy"), r6("magnitude", "magnitude"))


@query(f"WITH {GRAD_SQL}, s AS (SELECT frame_id, sum(gx * gx) AS xx, sum(gy * gy) AS yy, sum(gx * gy) AS xy FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY 1) SELECT frame_id, round(0.5 * atan2(2 * xy, xx - yy), 6) AS axis, round(sqrt(4 * xy * xy + (xx - yy) * (xx - yy)), 6) AS strength FROM s")
def gradient_axis(spark, sf):
    return px.gradient_axis(px.gradient(raster_pixels(spark, sf)), "frame_id").select("frame_id", r6("axis", "axis"), r6("strength", "strength"))


@query(f"WITH {PIXELS_SQL} SELECT frame_id, round(avg(1 - 2 * abs(1 / (1 + exp(-least(greatest(20 * (v - 0.5), -20), 20))) - 0.5)), 6) AS uncertainty FROM px GROUP BY 1")
def uncertainty(spark, sf):
    return raster_pixels(spark, sf).groupBy("frame_id").agg(r6(F.avg(sc.uncertainty(20.0 * (F.col("v") - 0.5))), "uncertainty"))


@query("""WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query, vec_id AS point, sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - qv[i]::DOUBLE) * (embedding[i]::DOUBLE - qv[i]::DOUBLE)))) AS d FROM q, embeddings WHERE vec_id <> query),
r AS (SELECT query, point, d, lead(d) OVER (PARTITION BY query ORDER BY d, point) AS d2, row_number() OVER (PARTITION BY query ORDER BY d, point) AS k FROM d)
SELECT query, point, round(d, 6) AS distance, round(d2, 6) AS d2, d < 0.72 * d2 AS matched FROM r WHERE k = 1""")
def knn_ratio(spark, sf):
    points = read_table(spark, sf, "embeddings")
    got = px.nearest_two(points, points.where("vec_id % 100 = 0"), "vec_id", "embedding")
    return got.select("query", "point", r6("distance", "distance"), r6("d2", "d2"), "matched")


@query(f"""WITH {PIXELS_SQL}, f AS (SELECT grp, frame_id, greatest(quantile_cont(v, 0.995) FILTER (pos < 32) - 0.5, 0) AS a, greatest(quantile_cont(v, 0.995) FILTER (pos >= 32) - 0.5, 0) AS b FROM px GROUP BY 1, 2),
d AS (SELECT s.grp, ln(s.a + 0.05) - ln(t.a + 0.05) AS p, ln(s.b + 0.05) - ln(t.b + 0.05) AS q FROM f s JOIN f t ON s.grp = t.grp AND s.frame_id < t.frame_id),
m AS (SELECT grp, avg(p) AS mp, avg(q) AS mq FROM d GROUP BY 1),
c AS (SELECT grp, sum((p - mp) * (q - mq)) AS pq, sum((p - mp) * (p - mp)) AS pp, sum((q - mq) * (q - mq)) AS qq, count(*) AS k FROM d JOIN m USING (grp) GROUP BY 1),
s AS (SELECT grp, count(*) AS n, greatest(avg(a), avg(b)) AS level FROM f GROUP BY 1),
e AS (SELECT grp, n, level, pq, pp, qq, least(sqrt(pp / k), sqrt(qq / k)) AS low, greatest(sqrt(pp / k), sqrt(qq / k)) AS high FROM s LEFT JOIN c USING (grp))
SELECT grp, n, round(CASE WHEN n < 3 OR level < 0.02 OR high < 0.25 THEN NULL WHEN low < 1e-9 THEN 0 ELSE least(greatest(pq / (sqrt(pp * qq) + 1e-6), -1), 1) * low / (high + 1e-6) END, 6) AS coherence FROM e""")
def pairwise_coherence(spark, sf):
    peak = lambda half: F.greatest(F.percentile(F.when(half, F.col("v")), F.lit(0.995)) - 0.5, F.lit(0.0))
    levels = raster_pixels(spark, sf).groupBy("grp", "frame_id").agg(peak(F.col("pos") < 32).alias("a"), peak(F.col("pos") >= 32).alias("b"))
    return px.intensity_coherence(levels, "grp", "frame_id", "a", "b").select("grp", "n", r6("coherence", "coherence"))


TWO_PATHS_SQL = PIXELS_SQL + """, two AS (SELECT p.frame_id, p.grp, p.x, p.y, p.v AS o, (p.v + m.v) / 2 AS r FROM px p JOIN px m ON p.frame_id = m.frame_id AND m.pos = 63 - p.pos),
t AS (SELECT frame_id, quantile_cont(o, 0.96) AS ot, quantile_cont(r, 0.96) AS rt FROM two GROUP BY 1),
c AS (SELECT grp, frame_id, sum(greatest(o - ot, 1e-6) * x) FILTER (o >= ot) / sum(greatest(o - ot, 1e-6)) FILTER (o >= ot) AS ox, sum(greatest(o - ot, 1e-6) * y) FILTER (o >= ot) / sum(greatest(o - ot, 1e-6)) FILTER (o >= ot) AS oy,
  sum(greatest(r - rt, 1e-6) * x) FILTER (r >= rt) / sum(greatest(r - rt, 1e-6)) FILTER (r >= rt) AS rx, sum(greatest(r - rt, 1e-6) * y) FILTER (r >= rt) / sum(greatest(r - rt, 1e-6)) FILTER (r >= rt) AS ry FROM two JOIN t USING (frame_id) GROUP BY 1, 2)"""


@query(f"""WITH {TWO_PATHS_SQL}, s AS (SELECT grp, ox - lag(ox) OVER w AS ax, oy - lag(oy) OVER w AS ay, rx - lag(rx) OVER w AS bx, ry - lag(ry) OVER w AS by_ FROM c WINDOW w AS (PARTITION BY grp ORDER BY frame_id)),
l AS (SELECT *, sqrt(ax * ax + ay * ay) AS al, sqrt(bx * bx + by_ * by_) AS bl FROM s WHERE ax IS NOT NULL),
g AS (SELECT grp, 0.5 * (1 - least(abs(al - bl) / (greatest(al, bl) + 1e-6), 1)) + 0.5 * CASE WHEN least(al, bl) < 1e-6 THEN 0 ELSE (1 + least(greatest((ax * bx + ay * by_) / (al * bl), -1), 1)) / 2 END AS score FROM l WHERE NOT (al < 1 AND bl < 1))
SELECT grp, count(*) AS steps, round(avg(score), 6) AS coherence FROM g GROUP BY 1""")
def temporal_coherence(spark, sf):
    """Each raster's highlight against that of its mean with its own half turn."""
    own = raster_pixels(spark, sf)
    turned = own.select("frame_id", (63 - F.col("pos")).alias("pos"), F.col("v").alias("u"))
    rendered = own.join(turned, ["frame_id", "pos"]).withColumn("v", (F.col("v") + F.col("u")) / 2).drop("u")
    got = px.temporal_coherence(px.highlight_centroid(own), px.highlight_centroid(rendered))
    return got.select("grp", "steps", r6("coherence", "coherence"))


@query(f"""WITH {PIXELS_SQL}, f AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY frame_id) AS k FROM (SELECT DISTINCT grp, frame_id FROM px)), o AS (SELECT px.*, k FROM px JOIN f USING (grp, frame_id))
SELECT a.grp, a.frame_id, round(avg(abs(a.v - b.v)), 6) AS delta FROM o a JOIN o b ON a.grp = b.grp AND a.pos = b.pos AND a.k = b.k + 1 GROUP BY 1, 2""")
def temporal_delta(spark, sf):
    return px.temporal_delta(raster_pixels(spark, sf)).select("grp", "frame_id", r6("delta", "delta"))


@query(f"""WITH {PIXELS_SQL}, c AS (SELECT frame_id, max(v) FILTER (pos = 0) AS r, max(v) FILTER (pos = 1) AS g, max(v) FILTER (pos = 2) AS b FROM px GROUP BY 1),
h AS (SELECT frame_id, atan2(sqrt(3.0::DOUBLE) / 2 * (g - b), r - 0.5::DOUBLE * (g + b)) AS hue, sqrt(pow(r - 0.5::DOUBLE * (g + b), 2) + pow(sqrt(3.0::DOUBLE) / 2 * (g - b), 2)) AS chroma FROM c)
SELECT least(floor((degrees(hue) + 180) / 36), 9)::BIGINT AS bin, count(*) AS n, round(atan2(sum(chroma * sin(hue)), sum(chroma * cos(hue))), 6) AS mean_hue FROM h GROUP BY 1""")
def hue_bins(spark, sf):
    plane = lambda k: F.max(F.when(F.col("pos") == k, F.col("v")))
    c = raster_pixels(spark, sf).groupBy("frame_id").agg(plane(0).alias("r"), plane(1).alias("g"), plane(2).alias("b"))
    hue, chroma = sc.opponent_hue(F.col("r"), F.col("g"), F.col("b"))
    h = c.select(hue.alias("hue"), chroma.alias("w"))
    bins = F.least(F.floor((F.degrees("hue") + 180) / 36), F.lit(9)).cast("long")
    return h.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), r6(F.atan2(F.sum(F.col("w") * F.sin("hue")), F.sum(F.col("w") * F.cos("hue"))), "mean_hue"))


@query(f"""WITH {ACTIVE_SQL}, a AS (SELECT DISTINCT grp, pos FROM act WHERE frame_id % 2 = 0), b AS (SELECT DISTINCT grp, pos FROM act WHERE frame_id % 2 = 1)
SELECT 'UNION' AS kind, grp, pos FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'SUBTRACT', grp, pos FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'INTERSECT', grp, pos FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'REPLACE', grp, pos FROM b""")
def mask_algebra(spark, sf):
    at = shared_folder(spark, "activation")
    px.activation(raster_pixels(spark, sf), share=0.75).select("frame_id", "grp", "pos").write.parquet(at)  # read eight times below
    act = spark.read.parquet(at)
    a, b = (act.where(F.col("frame_id") % 2 == k).select("grp", "pos") for k in (0, 1))
    out = [px.mask_set(k, a, b).select(F.lit(k).alias("kind"), "grp", "pos") for k in ("UNION", "SUBTRACT", "INTERSECT", "REPLACE")]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT grp, median(v) AS med, count(*) AS n, var_pop(v) AS variance, min(v) AS low, max(v) AS high FROM px GROUP BY 1), d AS (SELECT grp, median(abs(v - med)) AS mad FROM px JOIN m USING (grp) GROUP BY 1),
c AS (SELECT median(med) AS m, count(*) AS k FROM m), s AS (SELECT median(abs(med - m)) AS s FROM m, c)
SELECT grp, n, round(med, 6) AS med, round(mad, 6) AS mad, round(variance, 6) AS variance, round(low, 6) AS low, round(high, 6) AS high, round(0.6745 * abs(med - m) / greatest(s, 1e-4), 4) AS z, k >= 3 AND 0.6745 * abs(med - m) / greatest(s, 1e-4) > 3.5 AS outlier FROM m JOIN d USING (grp), c, s""")
def envelope_region(spark, sf):
    got = px.envelope(raster_pixels(spark, sf))
    return got.select("grp", "n", *[r6(c, c) for c in ("med", "mad", "variance", "low", "high")], F.round("z", 4).alias("z"), "outlier")


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT pos, avg(v) FILTER (grp % 4 = 0) AS l, avg(v) FILTER (grp % 4 = 1) AS r, avg(v) FILTER (grp % 4 = 2) AS t, avg(v) FILTER (grp % 4 = 3) AS b FROM px GROUP BY 1),
n AS (SELECT pos, 1.6 * (l - r) / greatest(l + r, 1e-6) AS nx, 1.6 * (t - b) / greatest(t + b, 1e-6) AS ny FROM m)
SELECT pos, round(nx / sqrt(nx * nx + ny * ny + 1), 6) AS nx, round(ny / sqrt(nx * nx + ny * ny + 1), 6) AS ny, round(1 / sqrt(nx * nx + ny * ny + 1), 6) AS nz FROM n""")
def normal_from_raking(spark, sf):
    side = lambda k: F.col("grp") % 4 == k
    return px.normals(raster_pixels(spark, sf), side(0), side(1), side(2), side(3)).select("pos", *[r6(c, c) for c in ("nx", "ny", "nz")])


@query(f"""WITH {PIXELS_SQL} SELECT frame_id, round(avg(0.2126::DOUBLE * CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END), 6) AS luma, round(avg(((v * 720 - 90 + 180) % 360 + 360) % 360 - 180), 6) AS signed FROM px GROUP BY 1""")
def colour_functions(spark, sf):
    lin = sc.srgb_to_linear(F.col("v"))
    return raster_pixels(spark, sf).groupBy("frame_id").agg(r6(F.avg(sc.luminance(lin, F.lit(0.0), F.lit(0.0))), "luma"), r6(F.avg(sc.signed_angle(F.col("v") * 720, F.lit(90.0))), "signed"))


# ---- fits and profiles

GRID_SQL = "grid AS (SELECT (s - 1)::INT AS id, s * 0.1::DOUBLE AS spec, 0.2::DOUBLE + 0.1::DOUBLE * (s % 3) AS rough FROM range(1, 10) t(s))"
RENDER_SQL = "(spec * exp(-0.5 * pow(sqrt(pow(x / 7.0::DOUBLE - 0.5, 2) + pow(y / 7.0::DOUBLE - 0.5, 2)) / (0.08 + 0.5 * rough), 2.0)))"


def light_grid(spark: SparkSession) -> DataFrame:
    s = F.col("id") + 1
    return spark.range(9).select(F.col("id").cast("int").alias("id")).withColumn("spec", s * 0.1).withColumn("rough", 0.2 + 0.1 * (s % 3))


def rendered() -> Column:
    return px.planar_light(F.col("x") / 7.0, F.col("y") / 7.0, F.lit(0.5), F.lit(0.5), F.col("spec"), F.col("rough"))


@query(f"WITH {PIXELS_SQL}, {GRID_SQL} SELECT id, pos, round(avg(v + {RENDER_SQL}), 6) AS v FROM px, grid GROUP BY 1, 2")
def planar_render(spark, sf):
    lit = raster_pixels(spark, sf).crossJoin(F.broadcast(light_grid(spark)))
    return lit.groupBy("id", "pos").agg(r6(F.avg(F.col("v") + rendered()), "v"))


@query(f"""WITH {PIXELS_SQL}, {GRID_SQL}, l AS (SELECT frame_id, id, round(avg(abs(v - {RENDER_SQL})), 9) AS loss FROM px, grid GROUP BY 1, 2)
SELECT frame_id, id, round(loss, 6) AS loss FROM l QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY loss, id) = 1""")
def grid_fit_argmin(spark, sf):
    got = fitting.grid_argmin(light_grid(spark), raster_pixels(spark, sf), "frame_id", F.abs(F.col("v") - rendered()), "id")
    return got.select("frame_id", "id", r6("loss", "loss"))


@query("SELECT l_orderkey, round(0.45 * avg(l_discount) + 0.55 * coalesce(sum(l_tax * l_quantity) / nullif(sum(l_quantity), 0), avg(l_discount)) + 1e-9, 6) AS frame_loss FROM lineitem GROUP BY 1")
def weighted_frame_loss(spark, sf):
    return fitting.frame_loss(read_table(spark, sf, "lineitem"), "l_orderkey", "l_discount", F.col("l_tax"), F.col("l_quantity")).select("l_orderkey", r6(F.col("frame_loss") + 1e-9, "frame_loss"))


@query("""SELECT p_partkey, round(floor(least(greatest(p_size / 25.0::DOUBLE * (0.4 + 0.6 * (p_partkey % 11) / 10.0::DOUBLE), 0), 2) * 10000 + 0.5) / 10000, 6) AS gloss, round(floor((55 + 70 * ((p_partkey % 7) / 6.0::DOUBLE)) * 10000 + 0.5) / 10000, 6) AS size,
 ((117 + p_size * 13) % 360)::DOUBLE AS band, round(floor(least(greatest(6 + p_retailprice / 2000 * 10, 6), 16) * 10000 + 0.5) / 10000, 6) AS width FROM part""")
def css_variables(spark, sf):
    p = read_table(spark, sf, "part")
    rows = p.select("p_partkey", (F.col("p_size") / 25.0).alias("gloss_strength"), (F.col("p_partkey") % 11 / 10.0).alias("clearcoat"), (F.col("p_partkey") % 7 / 6.0).alias("clearcoat_roughness"), (F.col("p_size") * 13.0).alias("rotation"), F.col("p_retailprice").alias("span"))
    return profiles.style_columns(rows).select("p_partkey", r6("gloss", "gloss"), r6("size", "size"), r6("band", "band"), r6("width", "width"))


@query(f"""WITH {COMPONENTS_SQL} SELECT source_id, least(useful_angles::DOUBLE, 16) AS detail_tilt, floor(least(useful_angles::DOUBLE, 16) + 0.5) / 2 AS grid_tilt,
 round(floor(least(greatest(0.7 * variant_confidence + 0.3 * score, 0), 1.4) * 10000 + 0.5) / 10000, 6) AS effective_foil, CASE tier WHEN 'A' THEN 'detail' WHEN 'B' THEN 'grid' ELSE 'static' END AS plan FROM tiered""")
def tier_plan(spark, sf):
    rows = tiered_sources(spark, sf).select("source_id", "tier", F.col("useful_angles").cast("double").alias("max_tilt"), F.col("variant_confidence").alias("foil"), F.col("score").alias("metal"))
    return profiles.tier_plan(rows).select("source_id", "detail_tilt", "grid_tilt", r6("effective_foil", "effective_foil"), "plan")


# ---- rasters in Python, one row each, and the streaming twin (no oracle: held against brute force in tests)

@query()
def band_energy(spark, sf):
    bands = imaging.per_raster(imaging.band_energy, "array<double>", F.col("embedding"), 8)
    return read_table(spark, sf, "embeddings").select("vec_id", F.transform(bands, lambda x: F.round(x, 6)).alias("bands"))


@query()
def structure_of_next(spark, sf):
    """Structural similarity of each raster with the next of its label."""
    e = read_table(spark, sf, "embeddings")
    pairs = px.next_frames(e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("grp")))
    both = pairs.join(e.select(F.col("vec_id").alias("f"), F.col("embedding").alias("a")), "f").join(e.select(F.col("vec_id").alias("g"), F.col("embedding").alias("b")), "g")
    return both.select("f", "g", F.round(imaging.per_pair(imaging.structure, "double", F.col("a"), F.col("b"), 8), 6).alias("structure"))


@query()
def bright_regions(spark, sf):
    return imaging.glare(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 0.1, 3)


@query()
def rectified(spark, sf):
    """Each raster's middle, warped to a 6 x 6 grid."""
    quad = [(1, 1), (6, 0.5), (6.5, 6), (0.5, 6.5)]
    got = imaging.per_raster(lambda img: imaging.warp(img, quad, 6, 6).ravel().tolist(), "array<double>", F.col("embedding"), 8)
    return read_table(spark, sf, "embeddings").select("vec_id", F.transform(got, lambda x: F.round(x, 6)).alias("warped"))


@query()
def sharpness(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(imaging.per_raster(imaging.laplacian_variance, "double", F.col("embedding"), 8), 6).alias("sharpness"))


@query(ORACLE_SQL["current_state"])
def current_state_stream(spark, sf):
    """current_state, folded by a stream over the events."""
    root = shared_folder(spark, "stream")
    stream = ledgers.running_state(ledgers.event_stream(spark, sf, "events.parquet"), "user_id", "ts", "event_id", "event_type")
    ledgers.drain(stream, f"{root}/out", f"{root}/checkpoint", "complete")
    return spark.read.parquet(f"{root}/out").select("user_id", "state", "events")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts_stream(spark, sf):
    root = shared_folder(spark, "stream")
    stream = ledgers.windowed_counts(ledgers.event_stream(spark, sf, "events.parquet"), "ts", "event_type", "1 day", "30 days")
    ledgers.drain(stream, f"{root}/out", f"{root}/checkpoint", "complete")
    return spark.read.parquet(f"{root}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


from quillon.plans import catalog_documents, catalog_fit, catalog_gates, catalog_ledgers, catalog_more, catalog_records  # noqa: E402, F401  register their queries
