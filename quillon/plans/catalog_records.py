"""Queries over records, parameters and appearance. Registered by catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import records as rec
from quillon.functions import scalar as sc
from quillon.operators import appearance, imaging, parameters
from quillon.operators import pixels as px
from quillon.plans.catalog import PIXELS_SQL, query, r6, raster_pixels
from quillon.session import read_table


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e, vec_id % 7 = 0 OR vec_id % 11 = 0 AS bad FROM embeddings),
p AS (SELECT vec_id, bad, e[1] AS ax, e[2] AS ay, e[3] + 8 AS bx, e[4] AS by_, e[5] + 8 AS cx, e[6] + 11 AS cy, e[7] AS dx, e[8] + 11 AS dy FROM q)
SELECT vec_id, CASE WHEN NOT bad THEN round((sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) + sqrt(pow(cx - dx, 2) + pow(cy - dy, 2))) / 2, 6) END AS width,
 CASE WHEN NOT bad THEN round((sqrt(pow(dx - ax, 2) + pow(dy - ay, 2)) + sqrt(pow(cx - bx, 2) + pow(cy - by_, 2))) / 2, 6) END AS height FROM p""")
def quad_records(spark, sf):
    """Quads written as JSON, as lists and as objects, some with three points or none, read back and measured."""
    e = lambda k, more=0: F.col("embedding")[k].cast("double") + more
    points = F.array(F.array(e(0), e(1)), F.array(e(2, 8), e(3)), F.array(e(4, 8), e(5, 11)), F.array(e(6), e(7, 11)))
    whole = F.to_json(points)
    k = F.col("vec_id")
    text = F.when(k % 7 == 0, F.to_json(F.slice(points, 1, 3))).when(k % 11 == 0, "oops").when(k % 5 == 0, F.concat(F.lit('{"corners":'), whole, F.lit("}"))).otherwise(whole)
    quads = read_table(spark, sf, "embeddings").select("vec_id", rec.parse_quad(text).alias("quad"))
    width, height = rec.side_lengths(F.col("quad"))
    return quads.select("vec_id", r6(width, "width"), r6(height, "height"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lower(source) || '-' || doc_id END AS frame_id,
 CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN 'pose:' || lower(lang) WHEN doc_id % 4 <> 0 THEN 'note:' || lower(source) END AS angle,
 CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id END AS inside, doc_id % 6 < 3 AS matches, doc_id % 3 = 1 AS accepted FROM documents""")
def record_texts(spark, sf):
    """Ids, labels, paths and matches of records whose fields are made from documents' own."""
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    notes = F.when(k % 4 != 0, F.concat(F.lit("seen; ANGLE: "), F.upper("source"), F.lit(" ; ANGLE: other"))).otherwise("ANGLE: \n no label")
    report = F.when(k % 6 == 0, F.concat(F.lit("OP-"), name)).when(k % 6 < 3, F.concat(F.lit("op-"), name, F.lit("-foil"))).when(k % 6 == 3, F.concat(F.lit("op-"), name, F.lit("x"))).when(k % 6 == 4, "").otherwise(F.lit(None))
    return read_table(spark, sf, "documents").select(
        "doc_id",
        rec.safe_frame_id(F.concat(F.when(k % 5 == 0, "_").otherwise(""), F.upper("source"), F.lit("-"), name)).alias("frame_id"),
        rec.angle_label(F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))), notes).alias("angle"),
        rec.relative_inside(F.lit("/data/"), F.concat(F.when(k % 2 == 0, "/data/").otherwise("/database/"), "source", F.lit("/"), name)).alias("inside"),
        rec.profile_id_matches(report, F.concat(F.lit("Op-"), name)).alias("matches"),
        rec.registration_accepted(F.when(k % 3 == 1, "accepted").when(k % 3 == 2, "rejected")).alias("accepted"),
    )


NAMES = ["renderer.foilStrength", "renderer.roughness", "renderer.iridescenceIor", "renderer.unknown"]


@query(f"""WITH s AS (SELECT p_partkey AS id, p_brand AS brand, ({NAMES})[p_partkey % 4 + 1] AS name, CASE WHEN p_size % 4 > 0 THEN (p_size - 5) / 20.0::DOUBLE END AS low, CASE WHEN p_size % 5 > 0 THEN p_size / 20.0::DOUBLE END AS high,
 CASE WHEN p_size % 6 > 0 THEN (p_size - 3) / 100.0::DOUBLE END AS step FROM part),
a AS (SELECT * FROM (VALUES ('renderer.foilStrength', 0.0, 2.0, 0.18, 0.01), ('renderer.roughness', 0.0, 1.0, 0.08, 0.005), ('renderer.iridescenceIor', 1.0, 2.333, 0.08, 0.005)) t(name, l, h, d, m)),
n AS (SELECT brand, name, count(*) AS n FROM s GROUP BY 1, 2),
j AS (SELECT id, s.name, coalesce(low, l)::DOUBLE AS low, coalesce(high, h)::DOUBLE AS high, coalesce(step, d)::DOUBLE AS step, l, h, m, n FROM s JOIN n USING (brand, name) LEFT JOIN a ON a.name = s.name)
SELECT id, concat_ws(',', CASE WHEN l IS NULL THEN 'unsupported' END, CASE WHEN l IS NOT NULL AND (low < l OR high > h OR high <= low) THEN 'bounds' END, CASE WHEN l IS NOT NULL AND (step <= 0 OR m > step) THEN 'steps' END, CASE WHEN n > 1 THEN 'repeated' END) AS reasons FROM j""")
def parameter_specs(spark, sf):
    size = F.col("p_size")
    rows = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("name"),
        F.when(size % 4 > 0, (size - 5) / 20.0).alias("low"),
        F.when(size % 5 > 0, size / 20.0).alias("high"),
        F.when(size % 6 > 0, (size - 3) / 100.0).alias("step"),
        F.lit(None).cast("double").alias("least_step"),
    )
    return parameters.check_specs(rows, "brand").select("id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT p_partkey, p_size % 7 / 4.0::DOUBLE AS a, p_size AS b, p_size % 9 * 100 AS low, p_size % 11 * 100 AS high FROM part)
SELECT p_partkey, sha256('{"renderer.foilStrength":' || CASE WHEN a = floor(a) THEN a::BIGINT::VARCHAR ELSE a::VARCHAR END || ',"renderer.roughness":' || b || '}') AS cache_key, low > high AS broken FROM p""")
def cache_keys(spark, sf):
    """Profiles as JSON, their cache key and whether the coupled thicknesses are out of order."""
    size = F.col("p_size")
    fields = F.struct((size % 7 / 4.0).alias("foilStrength"), size.alias("roughness"), (size % 9 * 100).alias("thicknessMin"), (size % 11 * 100).alias("thicknessMax"))
    rows = read_table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(fields.alias("renderer"))).alias("profile"))
    profile = F.col("profile")
    broken = rec.coupling_broken(rec.parameter(profile, "renderer.thicknessMin"), rec.parameter(profile, "renderer.thicknessMax"))
    return rows.select("p_partkey", rec.cache_key(profile, ["renderer.roughness", "renderer.foilStrength"]).alias("cache_key"), broken.alias("broken"))


@query("""WITH s AS (SELECT label AS grp, embedding[1]::DOUBLE * 360 AS axis, greatest(least(embedding[2]::DOUBLE * 4, 1), 0) AS chromatic, abs(embedding[3]::DOUBLE) + 0.1 AS weight, -30 * abs(embedding[4]::DOUBLE) AS low, 30 * abs(embedding[5]::DOUBLE) AS high FROM embeddings),
o AS (SELECT *, weight * chromatic AS w FROM s WHERE chromatic > 0), c AS (SELECT grp, (degrees(atan2(sum(w * sin(radians(axis))), sum(w * cos(radians(axis))))) % 360 + 360) % 360 AS dominant, avg(chromatic) AS coverage FROM o GROUP BY 1),
d AS (SELECT o.grp, w, dominant, (((axis - dominant + 180) % 360 + 360) % 360) - 180 AS away, low, high FROM o JOIN c USING (grp)),
l AS (SELECT grp, min(v) AS v FROM (SELECT grp, away + low AS v, sum(w) OVER (PARTITION BY grp ORDER BY away + low) AS c, sum(w) OVER (PARTITION BY grp) AS t FROM d) WHERE c >= 0.1 * t - 1e-9 GROUP BY 1),
h AS (SELECT grp, min(v) AS v FROM (SELECT grp, away + high AS v, sum(w) OVER (PARTITION BY grp ORDER BY away + high) AS c, sum(w) OVER (PARTITION BY grp) AS t FROM d) WHERE c >= 0.9 * t - 1e-9 GROUP BY 1)
SELECT g.grp, round(coalesce(dominant, 0), 5) AS dominant, round(coalesce(((dominant + l.v) % 360 + 360) % 360, 0), 5) AS min_deg, round(coalesce(((dominant + h.v) % 360 + 360) % 360, 0), 5) AS max_deg, round(coalesce(coverage, 0), 5) AS coverage
FROM (SELECT DISTINCT grp FROM s) g LEFT JOIN c ON c.grp = g.grp LEFT JOIN l ON l.grp = g.grp LEFT JOIN h ON h.grp = g.grp""")
def hue_range(spark, sf):
    e = lambda k: F.col("embedding")[k].cast("double")
    rows = read_table(spark, sf, "embeddings").select(F.col("label").alias("grp"), (e(0) * 360).alias("axis"), sc.clamp(e(1) * 4, 0, 1).alias("chromatic"), (F.abs(e(2)) + 0.1).alias("weight"), (-30 * F.abs(e(3))).alias("low"), (30 * F.abs(e(4))).alias("high"))
    return appearance.hue_range(rows, "grp").select("grp", *[F.round(c, 5).alias(c) for c in ("dominant", "min_deg", "max_deg", "coverage")])


ORDER_SQL = PIXELS_SQL + """, c AS (SELECT p.frame_id, p.pos, p.y, p.x, p.v AS r, q.v AS g, s.v AS b FROM px p JOIN px q ON p.frame_id = q.frame_id AND q.pos = (p.pos + 21) % 64 JOIN px s ON p.frame_id = s.frame_id AND s.pos = (p.pos + 42) % 64),
h AS (SELECT frame_id, pos, y, x, atan2(sqrt(3.0::DOUBLE) / 2 * (g - b), r - 0.5::DOUBLE * (g + b)) AS hue, sqrt(pow(r - 0.5::DOUBLE * (g + b), 2) + pow(sqrt(3.0::DOUBLE) / 2 * (g - b), 2)) AS chroma FROM c),
m AS (SELECT a.frame_id, a.y, a.x, a.hue AS ha, b.hue AS hb, least(a.chroma, b.chroma) AS w, round(a.x * cos(t.axis) + a.y * sin(t.axis), 9) AS place FROM h a JOIN h b ON a.frame_id = b.frame_id AND b.pos = (a.pos + 1) % 64 JOIN (SELECT vec_id AS frame_id, 3 * embedding[10]::DOUBLE AS axis FROM embeddings) t ON t.frame_id = a.frame_id),
k AS (SELECT frame_id, quantile_cont(place, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM m GROUP BY 1),
n AS (SELECT frame_id, len(list_filter(cuts, lambda c: place >= c)) AS bin, count(*) AS n, sum(w) AS w, atan2(sum(w * sin(ha)), sum(w * cos(ha))) AS a, atan2(sum(w * sin(hb)), sum(w * cos(hb))) AS b FROM m JOIN k USING (frame_id) GROUP BY 1, 2 HAVING count(*) >= 4 AND sum(w) > 1e-4),
z AS (SELECT frame_id, count(*) AS bins, atan2(sum(sin(a)), sum(cos(a))) AS ma, atan2(sum(sin(b)), sum(cos(b))) AS mb FROM n GROUP BY 1 HAVING count(*) >= 4 AND sqrt(pow(avg(sin(a)), 2) + pow(avg(cos(a)), 2)) <= 0.995 AND sqrt(pow(avg(sin(b)), 2) + pow(avg(cos(b)), 2)) <= 0.995)"""


@query(f"WITH {ORDER_SQL} SELECT frame_id, bins, round(sum(sin(a - ma) * sin(b - mb)) / sqrt(sum(pow(sin(a - ma), 2)) * sum(pow(sin(b - mb), 2))), 5) AS rho FROM n JOIN z USING (frame_id) GROUP BY 1, 2")
def hue_order(spark, sf):
    """Hues of planes shifted by a third of the raster, against those of the neighbour pixel, along an axis of each frame."""
    own = raster_pixels(spark, sf).select("frame_id", "pos", "y", "x", "v")
    plane = lambda by, name: own.select("frame_id", F.pmod(F.col("pos") - by, F.lit(64)).alias("pos"), F.col("v").alias(name))
    rgb = own.withColumnRenamed("v", "r").join(plane(21, "g"), ["frame_id", "pos"]).join(plane(42, "b"), ["frame_id", "pos"])
    hue, chroma = sc.opponent_hue(F.col("r"), F.col("g"), F.col("b"))
    hues = rgb.select("frame_id", "pos", "y", "x", hue.alias("hue_a"), chroma.alias("chroma_a"))
    other = hues.select("frame_id", F.pmod(F.col("pos") - 1, F.lit(64)).alias("pos"), F.col("hue_a").alias("hue_b"), F.col("chroma_a").alias("chroma_b"))
    both = hues.join(other, ["frame_id", "pos"]).select("frame_id", "y", "x", "hue_a", "hue_b", F.least("chroma_a", "chroma_b").alias("weight"))
    axes = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), (3 * F.col("embedding")[9].cast("double")).alias("axis"))
    return appearance.hue_order(both, axes).select("frame_id", "bins", F.round("rho", 5).alias("rho"))


@query(f"""WITH {PIXELS_SQL}, n AS (SELECT vec_id AS frame_id, 0.5 + embedding[1]::DOUBLE AS gx, 0.5 + embedding[2]::DOUBLE AS gy, embedding[3]::DOUBLE * 6 AS az, 45 + 60 * embedding[4]::DOUBLE AS el, least(greatest(0.5 + embedding[5]::DOUBLE, 0), 1) AS ro FROM embeddings),
d AS (SELECT frame_id, cos(az) * (x / 7.0::DOUBLE - gx) + sin(az) * (y / 7.0::DOUBLE - gy) AS a, cos(az) * (y / 7.0::DOUBLE - gy) - sin(az) * (x / 7.0::DOUBLE - gx) AS b, 0.04 + 0.3 * ro AS s, 1 + 1.5 * (1 - sin(radians(el))) AS e FROM px JOIN n USING (frame_id))
SELECT frame_id, count(*) FILTER (exp(-0.5 * pow(sqrt(pow(a / (s * e), 2) + pow(b / s, 2)) + 1e-6, 2.0)) > 0.5) AS lit FROM d GROUP BY 1""")
def lobe_mask(spark, sf):
    e = lambda k: F.col("embedding")[k].cast("double")
    lights = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), (0.5 + e(0)).alias("gx"), (0.5 + e(1)).alias("gy"), F.degrees(e(2) * 6).alias("az"), (45 + 60 * e(3)).alias("el"), sc.clamp(0.5 + e(4), 0, 1).alias("ro"))
    lit = appearance.in_lobe(F.col("x") / 7.0, F.col("y") / 7.0, F.col("gx"), F.col("gy"), F.col("az"), F.col("el"), F.col("ro"), F.lit(2.0))
    return raster_pixels(spark, sf).join(lights, "frame_id").groupBy("frame_id").agg(F.count_if(lit).alias("lit"))


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT p.frame_id, p.pos, p.v AS m, greatest(q.v - 0.6, 0) AS prior FROM px p JOIN px q ON p.frame_id = q.frame_id AND q.pos = 63 - p.pos), l AS (SELECT frame_id, avg(m) + 0.25 AS level FROM b WHERE prior > 0 GROUP BY 1)
SELECT frame_id, pos, round(CASE WHEN level IS NULL THEN m ELSE least(greatest(0.6 * m + 0.4 * greatest(m, prior * level), 0), 1) END, 6) AS v FROM b LEFT JOIN l USING (frame_id)""")
def prior_blend(spark, sf):
    own = raster_pixels(spark, sf).select("frame_id", "pos", F.col("v").alias("m"))
    prior = own.select("frame_id", (63 - F.col("pos")).alias("pos"), F.greatest(F.col("m") - 0.6, F.lit(0.0)).alias("prior"))
    return appearance.blend_prior(own.join(prior, ["frame_id", "pos"]), "frame_id", "m", "prior", 0.4, "v").select("frame_id", "pos", r6("v", "v"))


@query()
def texture_of_next(spark, sf):
    """Agreement of the band energies of each raster with those of the next of its label."""
    e = read_table(spark, sf, "embeddings")
    pairs = px.next_frames(e.select(F.col("vec_id").alias("frame_id"), F.col("label").alias("grp")))
    both = pairs.join(e.select(F.col("vec_id").alias("f"), F.col("embedding").alias("a")), "f").join(e.select(F.col("vec_id").alias("g"), F.col("embedding").alias("b")), "g")
    return both.select("f", "g", F.round(imaging.per_pair(imaging.texture_agreement, "double", F.col("a"), F.col("b"), 8), 6).alias("agreement"))


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT grp, frame_id, count(*) AS pixels, avg(CASE WHEN v >= 0.65 THEN 1.0 ELSE 0.0 END) AS clipped, median(v) AS med FROM px WHERE v > 0.55 GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN pixels < 16 THEN 'few_pixels' WHEN clipped > 0.35 THEN 'clipped' END AS early FROM s),
c AS (SELECT grp, median(med) AS m, count(*) AS n FROM e WHERE early IS NULL GROUP BY 1),
d AS (SELECT grp, median(abs(med - m)) AS sp FROM e JOIN c USING (grp) WHERE early IS NULL GROUP BY 1),
z AS (SELECT e.*, CASE WHEN early IS NULL AND n >= 3 THEN 0.6745 * abs(med - m) / greatest(sp, 1e-4) END AS z FROM e LEFT JOIN c USING (grp) LEFT JOIN d USING (grp))
SELECT grp, frame_id, pixels, round(clipped, 6) AS clipped, round(med, 6) AS med, round(z, 4) AS z, coalesce(early, CASE WHEN z > 3.5 THEN 'outlier' END) AS reason FROM z""")
def envelope_exclusions(spark, sf):
    """Which rasters take no part in the envelope of their label's bright pixels, and why."""
    bright = raster_pixels(spark, sf).where("v > 0.55").groupBy("grp", "frame_id")
    per = bright.agg(F.count("*").alias("pixels"), F.avg(F.when(F.col("v") >= 0.65, 1.0).otherwise(0.0)).alias("clipped"), F.percentile("v", 0.5).alias("med"))
    got = appearance.source_exclusions(per, "grp")
    return got.select("grp", "frame_id", "pixels", r6("clipped", "clipped"), r6("med", "med"), F.round("z", 4).alias("z"), "reason")


@query(f"""WITH {PIXELS_SQL}, t AS (SELECT pos, CASE WHEN pos % 9 > 0 THEN arg_max((frame_id % 7 - 3) * 10, (v, -frame_id)) FILTER (grp % 2 = 0) END AS a, arg_max((frame_id % 5 - 2) * 10, (v, -frame_id)) FILTER (grp % 2 = 1) AS b, max(v) - min(v) AS act FROM px GROUP BY 1),
w AS (SELECT pos, sin(radians(coalesce(a, 0))) AS x, sin(radians(coalesce(b, 0))) AS y, act FROM t), n AS (SELECT *, sqrt(x * x + y * y) AS size FROM w)
SELECT pos, round(CASE WHEN size > 1e-6 THEN x / size ELSE 1 END * 0.5 + 0.5, 6) AS x, round(CASE WHEN size > 1e-6 THEN y / size ELSE 0 END * 0.5 + 0.5, 6) AS y, round(least(greatest(act, 0), 1), 6) AS strength FROM n""")
def direction_map(spark, sf):
    """Direction of each pixel from the angles of its brightest frames on two tilts, one of them not measured everywhere."""
    rows = raster_pixels(spark, sf)
    angle = lambda k, m: ((F.col("frame_id") % m - k) * 10).cast("double")
    at = lambda side, a: F.max_by(a, F.when(F.col("grp") % 2 == side, F.struct("v", -F.col("frame_id"))))
    peaks = rows.groupBy("pos").agg(at(0, angle(3, 7)).alias("a"), at(1, angle(2, 5)).alias("b"), (F.max("v") - F.min("v")).alias("act"))
    peaks = peaks.withColumn("d", appearance.direction(F.when(F.col("pos") % 9 > 0, F.col("a")), F.col("b"), F.col("act")))
    return peaks.select("pos", *[r6(F.col(f"d.{c}"), c) for c in ("x", "y", "strength")])
