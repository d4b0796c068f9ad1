"""Further queries: fit metrics, joins, gates over paths and packets, top-k, requirements by rank. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scalar as sc
from quillon.operators import fitting, gates, metrics
from quillon.operators import pixels as px
from quillon.plans.catalog import CENTROID_SQL, LEDGER_SQL, PIXELS_SQL, SOURCES_SQL, brand_sources, query, r6, raster_pixels, rendered, user_ledger
from quillon.session import read_table

NEXT_SQL = PIXELS_SQL + """, pairs AS (SELECT * FROM (SELECT grp, frame_id AS f, lead(frame_id) OVER (PARTITION BY grp ORDER BY frame_id) AS g FROM (SELECT DISTINCT frame_id, grp FROM px)) WHERE g IS NOT NULL),
sides AS (SELECT p.f, p.g, a.pos, a.y, a.x, a.v AS a, b.v AS b FROM pairs p JOIN px a ON a.frame_id = p.f JOIN px b ON b.frame_id = p.g AND a.pos = b.pos)"""


def next_pairs(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return px.next_frames(e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("grp")))


@query(f"WITH {NEXT_SQL} SELECT f, g, round(avg(abs(a - b)), 6) AS mae, round(abs(avg(a) - avg(b)), 6) AS exposure FROM sides GROUP BY 1, 2")
def region_fit_metrics(spark, sf):
    got = metrics.absolute_error(metrics.paired(raster_pixels(spark, sf), next_pairs(spark, sf)), "f", "g")
    return got.select("f", "g", r6("mae", "mae"), r6("exposure", "exposure"))


@query(f"""WITH {CENTROID_SQL}, pairs AS (SELECT * FROM (SELECT grp, frame_id AS f, lead(frame_id) OVER (PARTITION BY grp ORDER BY frame_id) AS g FROM (SELECT DISTINCT frame_id, grp FROM px)) WHERE g IS NOT NULL)
SELECT p.f, p.g, round(CASE WHEN a.cx IS NULL AND b.cx IS NULL THEN 0 WHEN a.cx IS NULL OR b.cx IS NULL THEN 1 ELSE sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / 10.0 END, 6) AS centroid_error
FROM pairs p LEFT JOIN cen a ON a.frame_id = p.f LEFT JOIN cen b ON b.frame_id = p.g""")
def highlight_centroid_error(spark, sf):
    got = metrics.centroid_error(next_pairs(spark, sf), px.highlight_centroid(raster_pixels(spark, sf)), 10.0)
    return got.select("f", "g", r6("centroid_error", "centroid_error"))


@query("""WITH t AS (SELECT l_suppkey, radians(l_quantity * 7.0::DOUBLE) AS ha, radians(l_partkey * 11.0::DOUBLE % 360) AS hb, least(l_discount, l_tax) AS c FROM lineitem),
q AS (SELECT l_suppkey, quantile_cont(c, 0.35) AS q FROM t GROUP BY 1)
SELECT l_suppkey, round(sum(c * abs(atan2(sin(ha - hb), cos(ha - hb))) / pi()) / sum(c), 6) AS hue_error FROM t JOIN q USING (l_suppkey) WHERE c > q GROUP BY 1""")
def circular_hue_error(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_suppkey", F.radians(F.col("l_quantity") * 7.0).alias("ha"), F.radians(F.pmod(F.col("l_partkey") * 11.0, F.lit(360.0))).alias("hb"), "l_discount", "l_tax")
    return metrics.hue_error(rows, ["l_suppkey"], "ha", "hb", "l_discount", "l_tax").select("l_suppkey", r6("hue_error", "hue_error"))


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT grp, count(*) AS n, median(v) AS med, avg(CASE WHEN v <= 0.2 OR v >= 0.8 THEN 1.0::DOUBLE ELSE 0 END) AS clipped FROM px GROUP BY 1),
d AS (SELECT grp, median(abs(v - med)) AS mad FROM px JOIN m USING (grp) GROUP BY 1), c AS (SELECT grp, med + greatest(4 * 1.4826::DOUBLE * mad, 0.1) AS cut FROM m JOIN d USING (grp)),
s AS (SELECT grp, avg(CASE WHEN v > cut THEN 1.0::DOUBLE ELSE 0 END) AS specular FROM px JOIN c USING (grp) GROUP BY 1)
SELECT grp, n, round(clipped, 6) AS clipped, round(med, 6) AS med, round(mad, 6) AS mad, round(specular, 6) AS specular FROM m JOIN d USING (grp) JOIN s USING (grp)""")
def source_region_stats(spark, sf):
    got = metrics.region_stats(raster_pixels(spark, sf), 0.2, 0.8)
    return got.select("grp", "n", *[r6(c, c) for c in ("clipped", "med", "mad", "specular")])


@query(f"""WITH {PIXELS_SQL}, r AS (SELECT grp, frame_id, median(v / (0.3::DOUBLE + 0.05::DOUBLE * x + 1e-6)) AS r FROM px WHERE 0.3::DOUBLE + 0.05::DOUBLE * x > 0.02 GROUP BY 1, 2) SELECT grp, round(least(greatest(median(r), 0.25), 4), 6) AS exposure FROM r GROUP BY 1""")
def optimal_exposure(spark, sf):
    got = metrics.optimal_exposure(raster_pixels(spark, sf), "grp", "frame_id", F.col("v"), 0.3 + 0.05 * F.col("x"))
    return got.select("grp", r6("exposure", "exposure"))


@query(f"""WITH {PIXELS_SQL}, g AS (SELECT grp, frame_id, least(0.35 / greatest(median(v), 1e-6), 8) AS gain FROM px GROUP BY 1, 2) SELECT grp, pos, round(median(v * gain) / 0.85, 6) AS albedo FROM px JOIN g USING (grp, frame_id) GROUP BY 1, 2""")
def median_albedo(spark, sf):
    return metrics.median_stack(raster_pixels(spark, sf)).select("grp", "pos", r6("albedo", "albedo"))


@query(f"""WITH {PIXELS_SQL} SELECT frame_id, round(avg(v), 6) AS mean, round(0.5 / greatest(avg(v), 1e-6), 6) AS gain, round(avg(CASE WHEN v <= 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS dark, round(avg(CASE WHEN v >= 0.7 THEN 1.0::DOUBLE ELSE 0 END), 6) AS bright FROM px GROUP BY 1""")
def exposure_metadata(spark, sf):
    got = metrics.exposure_metadata(raster_pixels(spark, sf), 0.3, 0.7)
    return got.select("frame_id", *[r6(c, c) for c in ("mean", "gain", "dark", "bright")])


@query(f"""WITH {NEXT_SQL}, m AS (SELECT f, median(b - a) AS m FROM sides GROUP BY 1) SELECT f, round(avg(greatest(b - a - m, 0)), 6) AS activation, round(max(greatest(b - a - m, 0)), 6) AS peak FROM sides JOIN m USING (f) GROUP BY 1""")
def activation_fields(spark, sf):
    sides = metrics.paired(raster_pixels(spark, sf), next_pairs(spark, sf))
    return metrics.activation_field(sides, ["f"], "b", "a").groupBy("f").agg(r6(F.avg("activation"), "activation"), r6(F.max("activation"), "peak"))


@query("SELECT p_partkey, round((CASE WHEN p_size > 10 THEN p_size / 50.0::DOUBLE ELSE 0 END + p_retailprice / 2500 + CASE WHEN p_size > 40 THEN 0.9 ELSE 0 END)::DOUBLE / (1 + (p_size > 10)::INT + (p_size > 40)::INT), 6) AS composite FROM part")
def synthesis_composite(spark, sf):
    scores = [F.when(F.col("p_size") > 10, F.col("p_size") / 50.0), F.col("p_retailprice") / 2500, F.when(F.col("p_size") > 40, 0.9)]
    return read_table(spark, sf, "part").select("p_partkey", r6(metrics.composite(scores), "composite"))


@query("SELECT l_suppkey, round(sum(l_tax * l_discount) / sum(l_discount) + 1e-9, 6) AS loss FROM lineitem GROUP BY 1")
def prior_weighted_loss(spark, sf):
    return metrics.prior_weighted(read_table(spark, sf, "lineitem"), "l_suppkey", "l_tax", "l_discount").select("l_suppkey", r6(F.col("loss") + 1e-9, "loss"))


# ---- joins

@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.quality = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def quality_join(spark, sf):
    both = read_table(spark, sf, "documents").select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "rejected").otherwise("accepted").alias("status"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, sf):
    c, n, r = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def semi_join(spark, sf):
    big = read_table(spark, sf, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query(f"WITH {LEDGER_SQL} SELECT user_id, sequence, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS last_purchase FROM ledger")
def as_of_last(spark, sf):
    w = Window.partitionBy("user_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return user_ledger(spark, sf).select("user_id", F.col("sequence").cast("long").alias("sequence"), F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT conv_id, count(DISTINCT role) AS roles, arg_min(role, turn) AS first_role, count(DISTINCT role) > 1 AS conflict FROM conversations GROUP BY 1")
def prompt_lookup(spark, sf):
    return read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles"), F.min_by("role", "turn").alias("first_role"), (F.countDistinct("role") > 1).alias("conflict"))


# ---- gates

@query(f"""WITH {SOURCES_SQL} SELECT source_id, concat_ws(',', CASE WHEN variant_confidence < 0.5 THEN 'variant confidence' END, CASE WHEN proxy = 'high' THEN 'proxy risk' END, CASE WHEN editing = 'high' THEN 'editing' END) AS reasons FROM sources""")
def route_qualifying(spark, sf):
    rules = [(F.col("variant_confidence") < 0.5, "variant confidence"), (F.col("proxy") == "high", "proxy risk"), (F.col("editing") == "high", "editing")]
    return brand_sources(spark, sf).select("source_id", F.array_join(gates.reasons(rules), ",").alias("reasons"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%private%' THEN 'private' WHEN p_size > 40 AND p_retailprice > 1500 THEN 'too large' WHEN p_type LIKE 'PROMO%' THEN 'generated' END AS violation FROM part""")
def path_gate(spark, sf):
    rules = [(F.contains("p_name", F.lit("private")), "private"), ((F.col("p_size") > 40) & (F.col("p_retailprice") > 1500), "too large"), (F.startswith("p_type", F.lit("PROMO")), "generated")]
    return read_table(spark, sf, "part").select("p_partkey", gates.first_violation(rules).alias("violation"))


@query("SELECT url, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def unique_urls(spark, sf):
    return gates.duplicates(read_table(spark, sf, "pages"), "url")


@query("""SELECT p_partkey, round(least(greatest(coalesce(CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size / 40.0::DOUBLE END, 0.5), 0), 1), 6) AS foil, round(least(greatest(p_retailprice / 1500, 0.05), 1), 6) AS roughness FROM part""")
def normalize_profile(spark, sf):
    foil = F.coalesce(F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 40.0), F.lit(0.5))
    return read_table(spark, sf, "part").select("p_partkey", r6(sc.clamp(foil, 0, 1), "foil"), r6(sc.clamp(F.col("p_retailprice") / 1500, 0.05, 1), "roughness"))


@query(f"""WITH {LEDGER_SQL}, k AS (SELECT *, MAP {{'signup': 0, 'view': 1, 'click': 2, 'purchase': 3, 'error': 4}}[event_type] AS rank FROM ledger)
SELECT event_id, rank, concat_ws(',', CASE WHEN rank >= 2 AND props IS NULL THEN 'evidence' END, CASE WHEN rank >= 3 AND coalesce(value, 0) < 50 THEN 'metrics' END, CASE WHEN rank = 4 THEN 'human only' END) AS reasons FROM k""")
def rank_requirements(spark, sf):
    """What every event lacks that its rank asks for; low ranks ask for nothing."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("signup", "view", "click", "purchase", "error")) for x in (s, i)]), F.col("event_type"))
    rows = user_ledger(spark, sf).withColumn("rank", rank)
    rules = [((F.col("rank") >= 2) & F.col("props").isNull(), "evidence"), ((F.col("rank") >= 3) & (F.coalesce("value", F.lit(0.0)) < 50), "metrics"), (F.col("rank") == 4, "human only")]
    return rows.select("event_id", "rank", F.array_join(gates.reasons(rules), ",").alias("reasons"))


# ---- order and sets

@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def best_of_group(spark, sf):
    best = F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k")))
    return read_table(spark, sf, "part").groupBy("p_brand").agg((-best["k"]).alias("p_partkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 80")
def top_candidates(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(80)


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(sha256(text)))), ',') AS hashes FROM conversations GROUP BY 1")
def input_hashes(spark, sf):
    return read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set(F.sha2("text", 256))), ",").alias("hashes"))


@query("""WITH e AS (SELECT event_type, list_sort(list(DISTINCT json_extract_string(props, '$.k'))) AS ks FROM events GROUP BY 1)
SELECT event_type, len(list_filter(ks, lambda x: x IS NOT NULL)) AS n_values FROM e""")
def value_sets(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read_table(spark, sf, "events").groupBy("event_type").agg(F.countDistinct(k).alias("n_values"))


@query("SELECT doc_id, 'acq-' || substr(sha256(source || doc_id), 1, 16) || '-' || lang AS task, lower(substr(trim(source), 1, 10)) AS slug FROM documents")
def task_ids(spark, sf):
    d = read_table(spark, sf, "documents")
    digest = F.sha2(F.concat("source", F.col("doc_id").cast("string")), 256)
    return d.select("doc_id", F.substring(F.concat(F.lit("acq-"), F.substring(digest, 1, 16), F.lit("-"), "lang"), 1, 96).alias("task"), F.lower(F.substring(F.trim("source"), 1, 10)).alias("slug"))


@query()
def coordinate_fit(spark, sf):
    """Light parameters that fit the mean raster best, by coordinate descent; each step is one job over all pixels."""
    pixels = raster_pixels(spark, sf)

    def losses(some):
        grid = spark.createDataFrame([(i, c["spec"], c["rough"]) for i, c in enumerate(some)], "id int, spec double, rough double")
        got = pixels.crossJoin(F.broadcast(grid)).groupBy("id").agg(F.avg(F.abs(F.col("v") - 0.5 - rendered())).alias("loss")).collect()  # one row a candidate
        by = {r.id: r.loss for r in got}
        return [by[i] for i in range(len(some))]

    specs = [fitting.Parameter("spec", 0.0, 1.0, 0.25, 0.05), fitting.Parameter("rough", 0.05, 1.0, 0.25, 0.05)]
    best, loss, trials = fitting.coordinate_descent({"spec": 0.5, "rough": 0.5}, specs, losses, passes=4, trials=40)
    return spark.createDataFrame([(best["spec"], best["rough"], loss, trials)], "spec double, rough double, loss double, trials int")
