"""Queries that apply the scene operators to the driver's tables.

lineitem, part, supplier and nation stand in for observations, points, images and cameras; the first 62 numbers of an
embedding are the columns of a splat, its 64 numbers an 8 x 8 image. Results are rounded, since sums have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import harmonics, maths, permute, text
from pointloom.functions.maths import d
from pointloom.operators import calibrate, density, metrics, neighbours, rasters, render, structure, views
from pointloom.session import written
from pointloom.sources import files
from pointloom.streaming import control, requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x: Column, n: int = 6) -> Column:
    return F.round(x, n)


def rounded(df: DataFrame, columns: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c), n) for c in columns})


def splats(spark: SparkSession, sf: str) -> DataFrame:
    """gid, x y z, opacity, log scales, quaternion, and v, all values as doubles."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("v"))
    names = {"x": 0, "y": 1, "z": 2, "opacity": 54, "s0": 55, "s1": 56, "s2": 57, "q0": 58, "q1": 59, "q2": 60, "q3": 61}
    return v.select("gid", *(F.col("v")[i].alias(n) for n, i in names.items()), "v")


#: The same relation in SQL.
S = """s AS (SELECT vec_id AS gid, v[1] AS x, v[2] AS y, v[3] AS z, v[55] AS opacity, v[56] AS s0, v[57] AS s1, v[58] AS s2,
  v[59] AS q0, v[60] AS q1, v[61] AS q2, v[62] AS q3, v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"""

# ---- calibration of depth priors (flagship)


def depth_rows(spark: SparkSession, sf: str) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    images = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")
    seen = line.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").join(part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = seen.join(images, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_suppkey", (1000.0 / F.col("p_retailprice")).alias("model"), (1000.0 / F.col("l_extendedprice")).alias("prior"), (F.col("l_quantity") < 40).alias("valid"))


DEPTH = """o AS (
  SELECT l_suppkey, 1000.0::DOUBLE / p_retailprice AS model, 1000.0::DOUBLE / l_extendedprice AS prior, l_quantity < 40 AS valid
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT l_suppkey, count(*) FILTER (WHERE valid) AS n_valid, max(model) - min(model) AS range FROM o GROUP BY 1),
m AS (SELECT l_suppkey, median(model) AS tm, median(prior) AS tp FROM o WHERE valid GROUP BY 1),
s AS (SELECT l_suppkey, any_value(tm) AS tm, any_value(tp) AS tp, avg(abs(model - tm)) AS sm, avg(abs(prior - tp)) AS sp FROM o JOIN m USING (l_suppkey) WHERE valid GROUP BY 1),
p AS (SELECT l_suppkey, n_valid, CASE WHEN n_valid > 10 AND range > 1e-3 AND sp > 0 THEN sm / sp ELSE 0 END AS scale,
  CASE WHEN n_valid > 10 AND range > 1e-3 AND sp > 0 THEN tm - tp * (sm / sp) ELSE 0 END AS offset_ FROM n LEFT JOIN s USING (l_suppkey))"""


@query(f"WITH {DEPTH} SELECT l_suppkey, n_valid, round(scale, 6) AS scale, round(offset_, 6) AS shift FROM p")
def depth_calibration(spark, sf):
    out = calibrate.calibrate(depth_rows(spark, sf), ["l_suppkey"], "model", "prior", "valid")
    return out.select("l_suppkey", "n_valid", r(F.col("scale")).alias("scale"), r(F.col("offset")).alias("shift"))


@query(f"""WITH {DEPTH}, g AS (SELECT coalesce(median(scale) FILTER (WHERE scale > 0), 0) AS med FROM p)
SELECT l_suppkey, round(med, 6) AS med_scale, coalesce(NOT (scale < 0.97::DOUBLE * med OR scale > 1.03::DOUBLE * med), true) AS reliable FROM p, g""")
def depth_gate(spark, sf):
    params = calibrate.calibrate(depth_rows(spark, sf), ["l_suppkey"], "model", "prior", "valid")
    return calibrate.gate(params, 0.97, 1.03).select("l_suppkey", r(F.col("med_scale")).alias("med_scale"), "reliable")


# ---- splits and lookups

HOLD = "h AS (SELECT p_partkey, p_name, idx, idx % 8 = 0 AS is_test FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS idx FROM part))"


@query(f"WITH {HOLD} SELECT p_partkey, idx, is_test FROM h")
def llff_holdout(spark, sf):
    return views.hold_out(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "idx", "is_test")


@query(f"WITH {HOLD} SELECT p_partkey, 'train' AS split FROM h UNION ALL SELECT p_partkey, 'test' FROM h WHERE is_test")
def train_test_overlap(spark, sf):
    rows = views.hold_out(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])
    return views.splits(rows, overlap=True).select("p_partkey", "split")


@query("SELECT doc_id, quality IS NOT NULL AS known, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_params_lookup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("view_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"))
    params = table(spark, sf, "labels").select(F.concat(F.lit("view_"), F.col("doc_id").cast("string")).alias("stem"), "quality", "toxic")
    return views.with_params(docs, params).select("doc_id", F.col("quality").isNotNull().alias("known"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("quality", "toxic")))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS is_test FROM customer")
def membership_flag(spark, sf):
    names = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("name"))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("name"))
    return views.listed(rows, names).select("c_custkey", "is_test")


@query("SELECT s_suppkey, n_name, s_nationkey AS camera_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def image_camera_join(spark, sf):
    cameras = table(spark, sf, "nation").select(F.col("n_nationkey").alias("camera_id"), "n_name")
    return views.with_camera(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("camera_id")), cameras).select("s_suppkey", "n_name", "camera_id")


#: Observations of lineitem and the points they see: labels cover some ids below the largest one, so there are gaps.
SEEN = """seen AS (SELECT l_orderkey, l_linenumber, l_quantity, coalesce(quality, 0)::DOUBLE AS px, coalesce(toxic, 0)::DOUBLE AS py, coalesce(doc_id * 0.01::DOUBLE, 0) AS pz, doc_id IS NULL AS gap
  FROM lineitem LEFT JOIN labels ON l_partkey = doc_id WHERE l_partkey >= 0 AND l_partkey <= (SELECT max(doc_id) FROM labels))"""


def _observations(spark, sf) -> DataFrame:
    point = F.struct(F.col("l_orderkey").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"), F.col("l_partkey").alias("point3d_id"))
    images = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.array(point).alias("points2d"))
    points = table(spark, sf, "labels").select(F.col("doc_id").alias("point3d_id"), F.col("quality").cast("double").alias("x"), F.col("toxic").cast("double").alias("y"), (F.col("doc_id") * 0.01).alias("z"))
    return views.observations(images, points)


@query(f"WITH {SEEN} SELECT l_orderkey, l_linenumber, px, gap FROM seen")
def observation_points(spark, sf):
    return _observations(spark, sf).select(F.col("x").cast("long").alias("l_orderkey"), F.col("y").cast("int").alias("l_linenumber"), "px", "gap")


@query(f"""WITH {SEEN}, c AS (SELECT *, l_linenumber - 3 - px AS z FROM seen)
SELECT l_orderkey, l_linenumber, CASE WHEN z = 0 THEN -1 ELSE round(1.0::DOUBLE / z, 6) END AS invdepth, l_orderkey < 900 AND l_linenumber < 6 AND z >= 0 AS valid FROM c""")
def observation_depth(spark, sf):
    turn = F.array(*(d(v) for v in (0, 0, 1, 0, 1, 0, -1, 0, 0)))
    seen = _observations(spark, sf).withColumns({"r": turn, "t": F.array(d(0), d(0), F.col("y") - 3)})
    out = views.observed_depth(seen, 900, 6)
    shown = F.when(F.col("invdepth") == float("inf"), d(-1)).otherwise(r(F.col("invdepth")))
    return out.select(F.col("x").cast("long").alias("l_orderkey"), F.col("y").cast("int").alias("l_linenumber"), shown.alias("invdepth"), "valid")


@query("""WITH p AS (SELECT user_id, ts, max(event_id) AS pose FROM events WHERE event_type = 'view' OR event_type = 'error' GROUP BY 1, 2)
SELECT f.event_id, f.user_id, p.pose FROM (SELECT * FROM events WHERE NOT (event_type = 'view' OR event_type = 'error')) f ASOF JOIN p ON f.user_id = p.user_id AND f.ts >= p.ts""")
def pose_asof(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    is_pose = F.col("event_type").isin("view", "error")
    poses = events.filter(is_pose).select("event_id", "user_id", "t", F.col("event_id").alias("pose"))
    return views.as_of(events.filter(~is_pose).select("event_id", "user_id", "t"), poses, ["user_id"], "t", "event_id", ["pose"]).select("event_id", "user_id", "pose")


def iterations(spark, sf) -> DataFrame:
    """Events stand in for a training log, an iteration each."""
    return table(spark, sf, "events").select((F.col("event_id") * 5).alias("it"))


@query("SELECT it, it // n AS epoch, it % n AS slot FROM (SELECT event_id * 5 AS it FROM events), (SELECT count(*) AS n FROM supplier)")
def epoch_sampling(spark, sf):
    return views.epoch_slots(iterations(spark, sf), table(spark, sf, "supplier").count())


@query(f"""WITH RECURSIVE {permute.sql("SELECT count(*) FROM supplier", "SELECT DISTINCT n_nationkey::BIGINT FROM nation", 7)}
SELECT epoch, s_suppkey, slot FROM perm JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS view FROM supplier) USING (view)""")
def epoch_order(spark, sf):
    """An epoch for each nation."""
    return views.epoch_order(table(spark, sf, "supplier"), table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("epoch")), "s_suppkey", 7)


@query(f"""WITH RECURSIVE log AS (SELECT event_id * 5 AS it, event_id * 5 // n AS epoch, event_id * 5 % n AS slot FROM events, (SELECT count(*) AS n FROM supplier)),
{permute.sql("SELECT count(*) FROM supplier", "SELECT DISTINCT epoch FROM log", 3)}
SELECT it, epoch, slot, s_suppkey, it % 1000 = 0 AS raise_degree, it < 15000 AND it > 500 AND it % 100 = 0 AS densify, it < 15000 AND it % 3000 = 0 AS reset_opacity,
  CASE WHEN it > 3000 THEN 20 ELSE -1 END AS size_limit, least(it // 1000, 3)::INT AS degree
FROM log JOIN perm USING (epoch, slot) JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS view FROM supplier) USING (view)""")
def training_log(spark, sf):
    """Which view, triggers and harmonics degree each iteration of a log has."""
    log = views.training_log(iterations(spark, sf), table(spark, sf, "supplier"), "s_suppkey", 3)
    return views.triggers(log).withColumn("size_limit", F.coalesce("size_limit", F.lit(-1))).withColumn("degree", maths.sh_degree(F.col("it")))


@query("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) AS n FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) USING (n)")
def scene_sources(spark, sf):
    scenes = table(spark, sf, "supplier").select("s_suppkey", F.struct("s_name", "s_suppkey").alias("place"))
    return views.paired(scenes, table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("place"))).select("s_suppkey", "c_custkey")


@query("""SELECT it, it % 1000 = 0 AS raise_degree, it < 15000 AND it > 500 AND it % 100 = 0 AS densify, it < 15000 AND it % 3000 = 0 AS reset_opacity,
CASE WHEN it > 3000 THEN 20 ELSE -1 END AS size_limit FROM (SELECT event_id * 5 AS it FROM events)""")
def periodic_triggers(spark, sf):
    return views.triggers(iterations(spark, sf)).withColumn("size_limit", F.coalesce("size_limit", F.lit(-1)))


# ---- scalar maths


@query(f"""WITH {S} SELECT round(-avg(x), 6) AS tx, round(-avg(y), 6) AS ty, round(-avg(z), 6) AS tz, round(1.1::DOUBLE * max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)), 6) AS radius
FROM s, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM s)""")
def scene_norm(spark, sf):
    out = calibrate.scene_norm(splats(spark, sf), ["x", "y", "z"])
    return out.select(*(r(F.col(f"translate_{c}")).alias(f"t{c}") for c in "xyz"), r(F.col("radius")).alias("radius"))


@query(f"""WITH {S} SELECT gid, round(1 / (1 + exp(-opacity)), 6) AS alpha, round(exp(s0), 6) AS e0, round(exp(s1), 6) AS e1, round(exp(s2), 6) AS e2,
round(q0 / n, 6) AS w, round(q1 / n, 6) AS i, round(q2 / n, 6) AS j, round(q3 / n, 6) AS k, round(ln(abs(x) / (1 - abs(x))), 6) AS back
FROM (SELECT *, greatest(sqrt(q0*q0 + q1*q1 + q2*q2 + q3*q3), 1e-12) AS n FROM s)""")
def gaussian_activate(spark, sf):
    q = maths.normalize(*(F.col(f"q{k}") for k in range(4)))
    a = F.abs("x")
    return splats(spark, sf).select("gid", r(maths.sigmoid(F.col("opacity"))).alias("alpha"), *(r(F.exp(f"s{k}")).alias(f"e{k}") for k in range(3)), *(r(x).alias(n) for x, n in zip(q, "wijk", strict=True)), r(maths.logit(a)).alias("back"))


_ROT = ["1-2*(c*c+e*e)", "2*(b*c-a*e)", "2*(b*e+a*c)", "2*(b*c+a*e)", "1-2*(b*b+e*e)", "2*(c*e-a*b)", "2*(b*e-a*c)", "2*(c*e+a*b)", "1-2*(b*b+c*c)"]
ROT = "rot AS (SELECT *, " + ", ".join(f"{e} AS r{k}" for k, e in enumerate(_ROT)) + " FROM (SELECT *, q0/n AS a, q1/n AS b, q2/n AS c, q3/n AS e FROM (SELECT *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS n FROM s)))"


def unit_rotation() -> maths.Matrix:
    return maths.rotation(*(F.col(f"q{k}") for k in range(4)))


@query(f"WITH {S}, {ROT} SELECT gid, " + ", ".join(f"round(r{k}, 6) AS r{k}" for k in range(9)) + ", round(1-2*(q2*q2+q3*q3), 6) AS raw0 FROM rot")
def quat_rotation(spark, sf):
    m, raw = unit_rotation(), maths.rotation(*(F.col(f"q{k}") for k in range(4)), unit=False)
    return splats(spark, sf).select("gid", *(r(m[k // 3][k % 3]).alias(f"r{k}") for k in range(9)), r(raw[0][0]).alias("raw0"))


@query(f"WITH {S}, {ROT} SELECT gid, " + ", ".join(f"round(r{3*i}*r{3*j}*exp(s0)*exp(s0) + r{3*i+1}*r{3*j+1}*exp(s1)*exp(s1) + r{3*i+2}*r{3*j+2}*exp(s2)*exp(s2), 6) AS c{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM rot")
def covariance6(spark, sf):
    c = maths.covariance([F.exp(f"s{k}") for k in range(3)], unit_rotation())
    names = ["c00", "c01", "c02", "c11", "c12", "c22"]
    return splats(spark, sf).select("gid", *(r(x).alias(n) for x, n in zip(c, names, strict=True)))


@query(f"WITH {S}, {ROT} SELECT gid, round(sign(a) * a, 6) AS w, round(sign(a) * b, 6) AS i, round(sign(a) * c, 6) AS j, round(sign(a) * e, 6) AS k FROM rot")
def rotation_quat(spark, sf):
    q = maths.quaternion(unit_rotation())
    return splats(spark, sf).select("gid", *(r(x).alias(n) for x, n in zip(q, "wijk", strict=True)))


@query(f"WITH {S}, {ROT} SELECT gid, round(sign(a) * a, 5) AS w, round(sign(a) * b, 5) AS i, round(sign(a) * c, 5) AS j, round(sign(a) * e, 5) AS k FROM rot")
def rotation_quat_eigen(spark, sf):
    m = unit_rotation()
    rows = splats(spark, sf).select("gid", F.array(*(m[k // 3][k % 3] for k in range(9))).alias("r"))
    return neighbours.rotation_quaternions(rows).select("gid", *(r(F.col("q")[k], 5).alias(n) for k, n in enumerate("wijk")))


@query(f"""WITH {S}, {ROT}, c AS (SELECT *, (-(r0*x+r1*y+r2*z) + 1) * 2 AS cx, (-(r3*x+r4*y+r5*z)) * 2 AS cy, (-(r6*x+r7*y+r8*z) - 1) * 2 AS cz FROM rot)
SELECT gid, round(r0, 6) AS v00, round(r3, 6) AS v01, round(r1, 6) AS v10, round(-(r0*cx+r3*cy+r6*cz), 6) AS v03, round(-(r1*cx+r4*cy+r7*cz), 6) AS v13, round(-(r2*cx+r5*cy+r8*cz), 6) AS v23,
round(1 / tan((1 + abs(x)) / 2), 6) AS p00, round(100.0::DOUBLE / (100.0::DOUBLE - 0.01::DOUBLE), 6) AS p22, round(-1.0::DOUBLE / (100.0::DOUBLE - 0.01::DOUBLE), 6) AS p23 FROM c""")
def view_matrices(spark, sf):
    v = maths.world_to_view(unit_rotation(), [F.col(c) for c in "xyz"], (1.0, 0.0, -1.0), 2.0)
    p = maths.projection(0.01, 100.0, 1 + F.abs("x"), 1 + F.abs("y"))
    return splats(spark, sf).select("gid", *(r(v[i][j]).alias(f"v{i}{j}") for i, j in ((0, 0), (0, 1), (1, 0), (0, 3), (1, 3), (2, 3))), r(p[0][0]).alias("p00"), r(p[2][2]).alias("p22"), r(p[2][3]).alias("p23"))


@query(f"""WITH {S}, {ROT} SELECT gid, round(r0*v[4]+r1*v[5]+r2*v[6]+x, 6) AS cx, round(r6*v[4]+r7*v[5]+r8*v[6]+z, 6) AS cz, round(1/(r6*v[4]+r7*v[5]+r8*v[6]+z), 4) AS inv,
round(v[4] / (v[4] + v[5] + v[6] + 3 + 1e-7), 6) AS hx, round(r1 * -1, 6) AS f1, round(r0, 6) AS f0 FROM rot""")
def camera_points(spark, sf):
    m, p = unit_rotation(), [F.col("v")[k] for k in (3, 4, 5)]
    c = maths.to_camera(m, [F.col(k) for k in "xyz"], p)
    one, zero = d(1.0), d(0.0)
    h = maths.transform_point(p, [[one, zero, zero, zero], [zero, one, zero, zero], [zero, zero, one, zero], [one, one, one, d(3.0)]])
    flipped = maths.flip_axes(m)
    return splats(spark, sf).select("gid", r(c[0]).alias("cx"), r(c[2]).alias("cz"), r(maths.inverse_depth(c[2]), 4).alias("inv"), r(h[0]).alias("hx"), r(flipped[0][1]).alias("f1"), r(flipped[0][0]).alias("f0"))


@query("""SELECT p_partkey, round(2 * atan((p_size * 40) / (2 * p_retailprice)), 6) AS fov, round((p_size * 40) / (2 * tan(atan((p_size * 40) / (2 * p_retailprice)))), 4) AS focal,
p_size * 7 AS turned_cx FROM part""")
def fov_focal(spark, sf):
    pixels = (F.col("p_size") * 40).cast("double")
    fov = maths.focal_to_fov(F.col("p_retailprice"), pixels)
    turned = maths.quarter_turn(F.col("p_size") * 4, F.col("p_size") * 10, pixels, pixels, F.col("p_size"), F.col("p_size") * 3)
    return table(spark, sf, "part").select("p_partkey", r(fov).alias("fov"), r(maths.fov_to_focal(fov, pixels), 4).alias("focal"), turned[4].alias("turned_cx"))


_T = "least(greatest(it::DOUBLE / 30000, 0), 1)"


@query(f"""SELECT it, round(exp(ln(0.00016::DOUBLE) * (1 - {_T}) + ln(0.0000016::DOUBLE) * {_T}), 12) AS rate,
round((0.01::DOUBLE + 0.99::DOUBLE * sin(0.5::DOUBLE * pi() * least(greatest(it::DOUBLE / 1000, 0), 1))) * exp(ln(0.01::DOUBLE) * (1 - {_T}) + ln(0.001::DOUBLE) * {_T}), 12) AS eased,
least(it // 1000, 3)::INT AS degree FROM (SELECT event_id * 5 AS it FROM events)""")
def lr_schedule(spark, sf):
    it = F.col("it")
    return iterations(spark, sf).select(it, r(maths.learning_rate(it, 0.00016, 0.0000016, 30000), 12).alias("rate"), r(maths.learning_rate(it, 0.01, 0.001, 30000, 1000, 0.01), 12).alias("eased"), maths.sh_degree(it).alias("degree"))


@query("""WITH p AS (SELECT p_partkey, p_size * 113 AS w, p_size * 61 AS h, CASE p_partkey % 6 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 ELSE 640 END AS k FROM part),
t AS (SELECT *, CASE WHEN k = -1 THEN CASE WHEN w > 1600 THEN 1600 ELSE w END ELSE k END::DOUBLE AS target FROM p)
SELECT p_partkey, CASE WHEN k IN (1, 2, 4, 8) THEN round_even(w / k::DOUBLE, 0) ELSE trunc(w / (w / target)) END::INT AS out_w,
CASE WHEN k IN (1, 2, 4, 8) THEN round_even(h / k::DOUBLE, 0) ELSE trunc(h / (w / target)) END::INT AS out_h,
CASE WHEN k IN (1, 2, 4, 8) THEN round_even(w / (2.0::DOUBLE * k), 0) ELSE trunc(w / (w / target * 2.0::DOUBLE)) END::INT AS half_w FROM t""")
def resolution(spark, sf):
    k = F.element_at(F.array(*(F.lit(v) for v in (-1, 1, 2, 4, 8, 640))), (F.col("p_partkey") % 6 + 1).cast("int"))
    size = [(F.col("p_size") * n).cast("int") for n in (113, 61)]
    w, h = maths.resolution(*size, k)
    return table(spark, sf, "part").select("p_partkey", w.alias("out_w"), h.alias("out_h"), maths.resolution(*size, k, 2.0)[0].alias("half_w"))


def _sh_sql() -> str:
    n, p = "sqrt((x-1)*(x-1)+(y-2)*(y-2)+(z-3)*(z-3))", "pi()"
    k = [f"0.5*sqrt(1/{p})"]
    k += [f"-sqrt(3/(4*{p}))*b", f"sqrt(3/(4*{p}))*c", f"-sqrt(3/(4*{p}))*a"]
    k += [f"0.5*sqrt(15/{p})*a*b", f"-0.5*sqrt(15/{p})*b*c", f"0.25*sqrt(5/{p})*(3*c*c-1)", f"-0.5*sqrt(15/{p})*a*c", f"0.25*sqrt(15/{p})*(a*a-b*b)"]
    k += [f"-0.25*sqrt(35/(2*{p}))*b*(3*a*a-b*b)", f"0.5*sqrt(105/{p})*a*b*c", f"-0.25*sqrt(21/(2*{p}))*b*(5*c*c-1)", f"0.25*sqrt(7/{p})*c*(5*c*c-3)", f"-0.25*sqrt(21/(2*{p}))*a*(5*c*c-1)", f"0.25*sqrt(105/{p})*c*(a*a-b*b)", f"-0.25*sqrt(35/(2*{p}))*a*(a*a-3*b*b)"]
    out = []
    for deg in range(4):
        terms = " + ".join(f"({e})*{'v[7]' if i == 0 else f'v[{9 + i}]'}" for i, e in enumerate(k[: (deg + 1) ** 2]))
        out.append(f"round(greatest({terms} + 0.5, 0), 6) AS deg{deg}")
    return f"WITH {S} SELECT gid, {', '.join(out)}, round((v[8] - 0.5) / (0.5*sqrt(1/{p})), 6) AS dc FROM (SELECT *, (x-1)/{n} AS a, (y-2)/{n} AS b, (z-3)/{n} AS c FROM s)"


@query(_sh_sql())
def sh_color(spark, sf):
    v = F.col("v")
    red = [v[6], *(v[9 + i] for i in range(15))]
    out = [harmonics.colour(g, [red], [F.col(c) for c in "xyz"], [d(1.0), d(2.0), d(3.0)])[0] for g in range(4)]
    return splats(spark, sf).select("gid", *(r(c).alias(f"deg{g}") for g, c in enumerate(out)), r(harmonics.from_rgb(v[7])).alias("dc"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS m FROM embeddings), q AS (SELECT doc_id, (n_chars % 256) / 255.0::DOUBLE AS x, (n_chars % 16) / 15.0::DOUBLE AS y, 0.25::DOUBLE AS z FROM documents)
SELECT doc_id, """ + ", ".join(f"round(x*coalesce(m[{1 + j}],{float(j == 0)}) + y*coalesce(m[{5 + j}],{float(j == 1)}) + z*coalesce(m[{9 + j}],{float(j == 2)}) + coalesce(m[{4 * j + 4}],0), 6) AS c{j}" for j in range(3)) + " FROM q LEFT JOIN e ON doc_id = vec_id")
def exposure_affine(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("image_name"), ((F.col("n_chars") % 256) / 255).alias("x"), ((F.col("n_chars") % 16) / 15).alias("y"), d(0.25).alias("z"))
    flat = F.col("embedding").cast("array<double>")
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_name"), F.array(*(F.slice(flat, 4 * i + 1, 4) for i in range(3))).alias("m"))
    m = [[F.col("m")[i][j] for j in range(4)] for i in range(3)]
    out = harmonics.exposed([F.col(c) for c in "xyz"], m)
    return views.with_exposure(rows, known).select("doc_id", *(r(c).alias(f"c{j}") for j, c in enumerate(out)))


@query(f"""WITH {S}, m AS (SELECT *, 0.9::DOUBLE * y + 0.1::DOUBLE * x AS m1, 0.999::DOUBLE * abs(z) + 0.001::DOUBLE * x * x AS v1 FROM s)
SELECT gid, round(opacity - 0.025::DOUBLE * (m1 / (1 - 0.9::DOUBLE ** 5)) / (sqrt(v1 / (1 - 0.999::DOUBLE ** 5)) + 1e-15), 5) AS value, round(m1, 6) AS m1, round(v1, 6) AS v1,
round(ln(least(1/(1+exp(-opacity)), 0.01) / (1 - least(1/(1+exp(-opacity)), 0.01))), 6) AS reset FROM m""")
def adam_step(spark, sf):
    value, m, v = maths.adam(F.col("opacity"), F.col("x"), F.col("y"), F.abs("z"), 5, 0.025)
    return splats(spark, sf).select("gid", r(value, 5).alias("value"), r(m).alias("m1"), r(v).alias("v1"), r(density.reset_opacity(F.col("opacity"))).alias("reset"))


_RATE = "exp(ln(0.00016::DOUBLE) * (1 - 0.5::DOUBLE) + ln(0.0000016::DOUBLE) * 0.5::DOUBLE)"
_MOVED = "{c} - {rate} * ((0.9::DOUBLE * y + 0.1::DOUBLE * {g}) / (1 - 0.9::DOUBLE ** 5)) / (sqrt((0.999::DOUBLE * abs(z) + 0.001::DOUBLE * {g} * {g}) / (1 - 0.999::DOUBLE ** 5)) + 1e-15)"


@query(f"""WITH {S} SELECT gid, round(CASE WHEN gid % 3 > 0 THEN {_MOVED.format(c='x', rate=_RATE, g='s0')} ELSE x END, 9) AS x, round(CASE WHEN gid % 3 > 0 THEN {_MOVED.format(c='opacity', rate='0.025::DOUBLE', g='s1')} ELSE opacity END, 5) AS opacity,
round(CASE WHEN gid % 3 > 0 THEN 0.9::DOUBLE * y + 0.1::DOUBLE * s0 ELSE y END, 6) AS m_x FROM s""")
def adam_visible(spark, sf):
    rows = splats(spark, sf).select("gid", "x", "opacity", F.col("s0").alias("grad_x"), F.col("s1").alias("grad_opacity"), *(F.col("y").alias(f"m_{c}") for c in ("x", "opacity")), *(F.abs("z").alias(f"v_{c}") for c in ("x", "opacity")))
    rate = maths.learning_rate(F.lit(15_000), 0.00016, 0.0000016, 30_000)
    out = maths.adam_groups(rows, {"xyz": (["x"], rate), "opacity": (["opacity"], 0.025)}, 5, F.col("gid") % 3 > 0)
    return out.select("gid", r(F.col("x"), 9).alias("x"), r(F.col("opacity"), 5).alias("opacity"), r(F.col("m_x")).alias("m_x"))


@query(f"""WITH {S}, {ROT} SELECT gid, round(r1, 6) AS r1, round(r6, 6) AS r6, round(-(r0*x + r3*y + r6*z), 6) AS t0, round(-(r2*x + r5*y + r8*z), 6) AS t2, round(2 * atan(300 / (2 * (400 / (2 * tan(0.35::DOUBLE))))), 6) AS fov_y FROM rot""")
def transform_camera(spark, sf):
    m, p = unit_rotation(), [F.col(c) for c in "xyz"]
    frames = splats(spark, sf).select(F.col("gid").alias("idx"), F.col("gid").alias("image_name"), F.lit("").alias("file_path"), d(0.7).alias("camera_angle_x"), F.array(*(F.array(*m[i], p[i]) for i in range(3))).alias("c2w"))
    sizes = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_name"), F.lit(400).alias("width"), F.lit(300).alias("height"))
    out = files.transform_cameras(frames, sizes)
    return out.select(F.col("uid").alias("gid"), r(F.col("R")[1]).alias("r1"), r(F.col("R")[6]).alias("r6"), r(F.col("T")[0]).alias("t0"), r(F.col("T")[2]).alias("t2"), r(F.col("fov_y")).alias("fov_y"))


@query(f"""WITH {S}, {ROT}, k AS (SELECT *, """ + ", ".join(f"r{3*i}*r{3*j}*exp(s0)*exp(s0) + r{3*i+1}*r{3*j+1}*exp(s1)*exp(s1) + r{3*i+2}*r{3*j+2}*exp(s2)*exp(s2) AS k{i}{j}" for i in range(3) for j in range(i, 3)) + """, z + 3 AS d FROM rot),
j AS (SELECT *, 10/d AS fa, -10*x/(d*d) AS fb, 12/d AS fc, -12*y/(d*d) AS fe FROM k)
SELECT gid, round(fa*fa*k00 + 2*fa*fb*k02 + fb*fb*k22 + 0.3, 4) AS xx, round(fa*fc*k01 + fa*fe*k02 + fb*fc*k12 + fb*fe*k22, 4) AS xy, round(fc*fc*k11 + 2*fc*fe*k12 + fe*fe*k22 + 0.3, 4) AS yy FROM j""")
def projected_covariance(spark, sf):
    one, zero = d(1.0), d(0.0)
    view = [[one, zero, zero, zero], [zero, one, zero, zero], [zero, zero, one, d(3.0)]]
    cov = maths.covariance([F.exp(f"s{k}") for k in range(3)], unit_rotation())
    out = maths.projected_covariance(cov, view, [F.col(c) for c in "xyz"], d(10.0), d(12.0), 0.3)
    return splats(spark, sf).select("gid", *(r(c, 4).alias(n) for c, n in zip(out, ("xx", "xy", "yy"), strict=False)))


# ---- density control


def _stats(spark, sf) -> DataFrame:
    seen = table(spark, sf, "events").select(F.col("user_id").alias("gid"), (F.col("value") / 1000).alias("gx"), ((F.col("event_id") % 7) / 1000.0).alias("gy"), (F.col("event_id") % 30).cast("int").alias("radius"))
    return density.accumulate(seen)


STATS = """st AS (SELECT user_id AS gid, sum(sqrt((value / 1000) ** 2 + ((event_id % 7) / 1000.0::DOUBLE) ** 2)) AS grad_accum, count(*) AS denom, max(event_id % 30) AS max_radius
  FROM events WHERE event_id % 30 > 0 GROUP BY 1)"""
TAU, DENSE, EXTENT, NEXT = 0.02, 0.01, 110.0, 1_000_000


@query(f"WITH {STATS} SELECT gid, round(grad_accum, 6) AS grad_accum, denom, max_radius::INT AS max_radius FROM st")
def accumulate_stats(spark, sf):
    return rounded(_stats(spark, sf), ["grad_accum"])


_COLS = ["x", "y", "z", "opacity", "s0", "s1", "s2", "q0", "q1", "q2", "q3"]
_C = ", ".join(_COLS)


def _step_sql(g: str, k: str, start: str) -> str:
    """Clones cl, children ch, both numbered in nw, and the rows before pruning in a, from a table g; k ends their names."""
    return f"""cl{k} AS (SELECT gid AS p, 0 AS slot, {_C} FROM {g} WHERE grad >= {TAU} AND big <= {DENSE}::DOUBLE * {EXTENT}::DOUBLE),
sp{k} AS (SELECT *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS n FROM {g} WHERE grad >= {TAU} AND big > {DENSE}::DOUBLE * {EXTENT}::DOUBLE),
sq{k} AS (SELECT *, q0/n AS a, q1/n AS b, q2/n AS c, q3/n AS e, child, (gid % 5 - 2 + child) * exp(s0) AS t0, (gid % 3 - 1) * exp(s1) AS t1, (child * 2 - 1) * exp(s2) AS t2 FROM sp{k}, (VALUES (0), (1)) k(child)),
ch{k} AS (SELECT gid AS p, child + 1 AS slot, x + (1-2*(c*c+e*e))*t0 + 2*(b*c-a*e)*t1 + 2*(b*e+a*c)*t2 AS x, y + 2*(b*c+a*e)*t0 + (1-2*(b*b+e*e))*t1 + 2*(c*e-a*b)*t2 AS y,
  z + 2*(b*e-a*c)*t0 + 2*(c*e+a*b)*t1 + (1-2*(b*b+c*c))*t2 AS z, opacity, ln(exp(s0)/1.6::DOUBLE) AS s0, ln(exp(s1)/1.6::DOUBLE) AS s1, ln(exp(s2)/1.6::DOUBLE) AS s2, q0, q1, q2, q3 FROM sq{k}),
nw{k} AS (SELECT {start} + row_number() OVER (ORDER BY p, slot) - 1 AS gid, {_C} FROM (SELECT * FROM cl{k} UNION ALL SELECT * FROM ch{k})),
a{k} AS (SELECT gid, {_C} FROM {g} WHERE NOT (grad >= {TAU} AND big > {DENSE}::DOUBLE * {EXTENT}::DOUBLE) UNION ALL SELECT * FROM nw{k})"""


_BIG = "greatest(exp(s0), exp(s1), exp(s2)) AS big"
G = f"""{S}, {STATS}, g AS (SELECT gid, {_C}, coalesce(grad_accum / denom, 0) AS grad, coalesce(max_radius, 0) AS max_radius, {_BIG} FROM s LEFT JOIN st USING (gid)),
{_step_sql('g', '', str(NEXT))}"""
_OUT = "gid, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(s0, 5) AS s0, round(opacity, 5) AS opacity"


def _noise(rows: DataFrame) -> DataFrame:
    two = rows.select("gid", F.explode(F.array(F.lit(0), F.lit(1))).alias("child"))
    return two.select("gid", "child", (F.col("gid") % 5 - 2 + F.col("child")).alias("n0"), (F.col("gid") % 3 - 1).alias("n1"), (F.col("child") * 2 - 1).alias("n2"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("gid", *(r(F.col(c), 5).alias(c) for c in ("x", "y", "z", "s0", "opacity")))


def _numbered(rows: str) -> str:
    return f"(SELECT {NEXT} + row_number() OVER (ORDER BY p, slot) - 1 AS gid, * FROM {rows})"


@query(f"WITH {G} SELECT {_OUT} FROM {_numbered('cl')}")
def densify_clone(spark, sf):
    return _shown(density.numbered(density.clones(density.with_gradient(splats(spark, sf).drop("v"), _stats(spark, sf)), TAU, EXTENT, DENSE), NEXT))


@query(f"WITH {G} SELECT {_OUT} FROM {_numbered('ch')}")
def densify_split(spark, sf):
    rows = splats(spark, sf).drop("v")
    return _shown(density.numbered(density.children(density.with_gradient(rows, _stats(spark, sf)), _noise(rows), TAU, EXTENT, DENSE), NEXT))


@query(f"WITH {G} SELECT {_OUT} FROM g WHERE NOT (1/(1+exp(-opacity)) < 0.5 OR max_radius > 20 OR big > 0.1::DOUBLE * 14)")
def densify_prune(spark, sf):
    return _shown(density.prune(density.with_gradient(splats(spark, sf).drop("v"), _stats(spark, sf)), 0.5, 14.0, 20.0))


@query(f"WITH {G} SELECT {_OUT} FROM a WHERE 1/(1+exp(-opacity)) >= 0.45")
def densify_control(spark, sf):
    rows = splats(spark, sf).drop("v")
    return _shown(density.control(rows, _stats(spark, sf), _noise(rows), TAU, 0.45, EXTENT, None, DENSE, NEXT))


@query(f"""WITH {G}, b AS (SELECT * FROM a WHERE 1/(1+exp(-opacity)) >= 0.45), g2 AS (SELECT *, gid % 11 * 0.01::DOUBLE AS grad, {_BIG} FROM b),
{_step_sql('g2', '2', '(SELECT max(gid) + 1 FROM b)')} SELECT {_OUT} FROM a2 WHERE 1/(1+exp(-opacity)) >= 0.45""")
def densify_twice(spark, sf):
    """The second step works on the copies of the first and numbers its own after them."""
    rows = splats(spark, sf).drop("v")
    once = written(density.control(rows, _stats(spark, sf), _noise(rows), TAU, 0.45, EXTENT, None, DENSE, NEXT), "step")
    stats = once.select("gid", (F.col("gid") % 11 * 0.01).alias("grad_accum"), F.lit(1).alias("denom"), F.lit(0).alias("max_radius"))
    return _shown(density.control(once, stats, _noise(once), TAU, 0.45, EXTENT, None, DENSE))


@query(f"""WITH {S}, p AS (SELECT a.gid, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM s a JOIN s b ON a.gid <> b.gid),
k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d2) AS n FROM p)
SELECT gid, round(avg(d2), 6) AS dist2, round(ln(sqrt(greatest(avg(d2), 1e-7))), 4) AS init_scale FROM k WHERE n <= 3 GROUP BY gid""")
def knn_init_scale(spark, sf):
    near = neighbours.mean_distance2(splats(spark, sf).select("gid", "x", "y", "z"))
    return near.select("gid", r(F.col("dist2")).alias("dist2"), r(F.ln(F.sqrt(maths.clamp(F.col("dist2"), low=1e-7))), 4).alias("init_scale"))


# ---- images


def image_pairs(spark, sf) -> DataFrame:
    """Pairs of 8 x 8 images (vectors n and n + 1), values moved into 0..1; one channel."""
    pix = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    pix = pix.select("vec_id", F.lit(0).alias("c"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), (F.col("v") / 2 + 0.5).alias("v"))
    truth = pix.withColumn("vec_id", F.col("vec_id") - 1)
    return metrics.pairs(pix, truth, ["vec_id"])


PAIRS = """px AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding[1:64])::DOUBLE / 2 + 0.5::DOUBLE AS v FROM embeddings),
pr AS (SELECT a.vec_id, (a.p // 8)::INT AS y, (a.p % 8)::INT AS x, a.v AS a, b.v AS b FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.p = b.p)"""


@query(f"WITH {PAIRS} SELECT vec_id, round(avg(abs(a - b)), 6) AS l1, round(avg((a-b)*(a-b)), 6) AS mse, round(-10 * log10(avg((a-b)*(a-b))), 4) AS psnr FROM pr GROUP BY 1")
def image_l1_l2_psnr(spark, sf):
    out = metrics.errors(image_pairs(spark, sf), ["vec_id"])
    return out.select("vec_id", r(F.col("l1")).alias("l1"), r(F.col("mse")).alias("mse"), r(F.col("psnr"), 4).alias("psnr"))


_W = """w AS (SELECT i - 5 AS o, exp(-((i - 5) ** 2) / 4.5::DOUBLE) / (SELECT sum(exp(-((j - 5) ** 2) / 4.5::DOUBLE)) FROM range(11) q(j)) AS k FROM range(11) t(i))"""
SSIM = f"""{PAIRS}, {_W},
m AS (SELECT q.vec_id, q.y, q.x, sum(u.k*h.k*n.a) AS ma, sum(u.k*h.k*n.b) AS mb, sum(u.k*h.k*n.a*n.a) AS aa, sum(u.k*h.k*n.b*n.b) AS bb, sum(u.k*h.k*n.a*n.b) AS ab
  FROM pr q CROSS JOIN w u CROSS JOIN w h JOIN pr n ON n.vec_id = q.vec_id AND n.x = q.x + u.o AND n.y = q.y + h.o GROUP BY 1, 2, 3),
ss AS (SELECT vec_id, avg((2*ma*mb + 1e-4) * (2*(ab - ma*mb) + 9e-4) / ((ma*ma + mb*mb + 1e-4) * ((aa - ma*ma) + (bb - mb*mb) + 9e-4))) AS ssim FROM m GROUP BY 1)"""


@query(f"WITH {SSIM} SELECT vec_id, round(ssim, 5) AS ssim FROM ss")
def ssim_8x8(spark, sf):
    return rounded(metrics.ssim(image_pairs(spark, sf), ["vec_id"]), ["ssim"], 5)


@query(f"""WITH {SSIM}, e AS (SELECT vec_id, avg(abs(a - b)) AS l1, -10 * log10(avg((a-b)*(a-b))) AS psnr FROM pr GROUP BY 1)
SELECT vec_id % 5 AS scene, vec_id % 2 AS method, count(*) AS images, round(avg(psnr), 4) AS psnr, round(avg(ssim), 4) AS ssim, round(avg(0.8::DOUBLE * l1 + 0.2::DOUBLE * (1 - ssim)), 5) AS loss FROM e JOIN ss USING (vec_id) GROUP BY 1, 2""")
def metric_rollup(spark, sf):
    both = image_pairs(spark, sf)
    per_view = metrics.errors(both, ["vec_id"]).join(metrics.ssim(both, ["vec_id"]), "vec_id")
    per_view = per_view.withColumn("loss", metrics.total_loss(F.col("l1"), F.col("ssim"), d(0.0), d(0.0)))
    per_view = per_view.withColumns({"scene": F.col("vec_id") % 5, "method": F.col("vec_id") % 2})
    count = per_view.groupBy("scene", "method").agg(F.count("*").alias("images"))
    return rounded(rounded(metrics.roll_up(per_view, ["scene", "method"], ["psnr", "ssim", "loss"]), ["psnr", "ssim"], 4), ["loss"], 5).join(count, ["scene", "method"])


@query(f"WITH {PAIRS} SELECT vec_id, round(avg(abs(a - b)), 6) AS l1 FROM pr WHERE x >= 4 GROUP BY 1")
def half_image_metrics(spark, sf):
    return rounded(metrics.errors(views.half(image_pairs(spark, sf), F.lit(8)), ["vec_id"]).select("vec_id", "l1"), ["l1"])


@query(f"""WITH {PAIRS} SELECT vec_id, round(avg(CASE WHEN (x + y) % 3 = 0 THEN a ELSE a * 0.5::DOUBLE END), 6) AS masked, round(avg(a * b + 1.0::DOUBLE * (1 - b)), 6) AS over_white FROM pr GROUP BY 1""")
def alpha_mask(spark, sf):
    alpha = F.when((F.col("x") + F.col("y")) % 3 != 0, d(0.5))
    return rounded(image_pairs(spark, sf).groupBy("vec_id").agg(F.avg(views.masked(F.col("a"), alpha)).alias("masked"), F.avg(maths.over_background(F.col("a"), F.col("b"), 1.0)).alias("over_white")), ["masked", "over_white"])


@query(f"""WITH {PAIRS}, q AS (SELECT vec_id, 0.37::DOUBLE + vec_id % 9 AS sx, 2.75::DOUBLE AS sy FROM embeddings),
c AS (SELECT vec_id, sx, sy, least(floor(sx) + i, 7)::INT AS x, least(floor(sy) + j, 7)::INT AS y, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS k
  FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT vec_id, round(sum(k * a), 6) AS v FROM c JOIN pr USING (vec_id, x, y) GROUP BY 1""")
def bilinear_sample(spark, sf):
    pixels = image_pairs(spark, sf).select("vec_id", "x", "y", F.col("a").alias("v"))
    asked = table(spark, sf, "embeddings").select("vec_id", (d(0.37) + F.col("vec_id") % 9).alias("sx"), d(2.75).alias("sy"))
    return rasters.bilinear(asked, rasters.from_pixels(pixels, ["vec_id"], 4), ["vec_id"], 4).select("vec_id", r(F.col("v")).alias("v"))


@query("""WITH f AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS a, embedding[9:16]::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: 0.5::DOUBLE * (a[i] / (sqrt(list_sum(list_transform(a, lambda q: q * q))) + 1e-10) - b[i] / (sqrt(list_sum(list_transform(b, lambda q: q * q))) + 1e-10)) ** 2)), 6) AS distance FROM f""")
def feature_distance(spark, sf):
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf, "embeddings").select("vec_id", F.lit(0).alias("layer"), F.slice(v, 1, 8).alias("fa"), F.slice(v, 9, 8).alias("fb"), F.array_repeat(d(0.5), 8).alias("weight"))
    return rounded(metrics.feature_distance(rows, ["vec_id"]), ["distance"])


@query(f"""WITH {S}, h AS (SELECT gid % 40 AS px, z, gid, least(1/(1+exp(-opacity)), 0.99) AS a, abs(x) AS red FROM s),
w AS (SELECT *, a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY px ORDER BY z, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM h)
SELECT px, round(sum(k * red) + 0.5::DOUBLE * exp(sum(ln(1 - a))), 6) AS red, round(exp(sum(ln(1 - a))), 6) AS transmittance FROM w GROUP BY 1""")
def composite_splats(spark, sf):
    hits = splats(spark, sf).select((F.col("gid") % 40).alias("px"), F.col("z").alias("depth"), "gid", maths.sigmoid(F.col("opacity")).alias("alpha"), F.abs("x").alias("red"))
    return rounded(metrics.composite(hits, ["px"], ["red"], background=0.5), ["red", "transmittance"])


@query(f"""WITH {S}, {ROT}, k AS (SELECT *, """ + ", ".join(f"0.0025::DOUBLE * (r{3*i}*r{3*j}*exp(s0)*exp(s0) + r{3*i+1}*r{3*j+1}*exp(s1)*exp(s1) + r{3*i+2}*r{3*j+2}*exp(s2)*exp(s2)) AS k{i}{j}" for i in range(3) for j in range(i, 3)) + """, z + 3 AS d FROM rot WHERE z + 3 > 0.2),
j AS (SELECT *, 30/d AS fa, -30*x/(d*d) AS fb, 28/d AS fc, -28*y/(d*d) AS fe FROM k),
t AS (SELECT gid, x, y, z, d, opacity, 30*x/d + 15.5::DOUBLE AS pu, 28*y/d + 11.5::DOUBLE AS pv, fa*fa*k00 + 2*fa*fb*k02 + fb*fb*k22 + 0.3::DOUBLE AS xx, fa*fc*k01 + fa*fe*k02 + fb*fc*k12 + fb*fe*k22 AS xy, fc*fc*k11 + 2*fc*fe*k12 + fe*fe*k22 + 0.3::DOUBLE AS yy FROM j),
b AS (SELECT *, xx*yy - xy*xy AS det, ceil(3 * sqrt((xx+yy)/2 + sqrt(greatest(((xx+yy)/2)*((xx+yy)/2) - (xx*yy - xy*xy), 0)))) AS rad FROM t),
h AS (SELECT gid, d, u, v, abs(x) AS red, abs(y) AS green, abs(z) AS blue, least(exp(-0.5::DOUBLE * (yy/det*(u-pu)*(u-pu) + xx/det*(v-pv)*(v-pv)) + xy/det*(u-pu)*(v-pv)) / (1 + exp(-opacity)), 0.99) AS a
  FROM b, range(32) p(u), range(24) q(v) WHERE u // 16 BETWEEN floor((pu-rad)/16) AND floor((pu+rad)/16) AND v // 16 BETWEEN floor((pv-rad)/16) AND floor((pv+rad)/16)),
w AS (SELECT *, a * exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY u, v ORDER BY d, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM h WHERE a >= 1.0::DOUBLE / 255),
s2 AS (SELECT u, v, sum(k*red) AS red, sum(k*green) AS green, sum(k*blue) AS blue, sum(k/d) AS inv, exp(sum(ln(1 - a))) AS left_ FROM w GROUP BY 1, 2)
SELECT p.u::INT AS u, q.v::INT AS v, round(least(coalesce(red, 0) + coalesce(left_, 1), 1), 5) AS red, round(least(coalesce(green, 0) + 0.5::DOUBLE * coalesce(left_, 1), 1), 5) AS green, round(least(coalesce(blue, 0), 1), 5) AS blue,
  round(coalesce(inv, 0), 5) AS inverse_depth, round(coalesce(left_, 1), 5) AS transmittance FROM range(32) p(u) CROSS JOIN range(24) q(v) LEFT JOIN s2 ON s2.u = p.u AND s2.v = q.v""")
def render_view(spark, sf):
    rows = splats(spark, sf).withColumns({c: F.abs(k) for c, k in zip(render.COLOURS, "xyz", strict=True)})
    out = render.render(rows, render.View(32, 24, 30.0, 28.0, translation=(0.0, 0.0, 3.0)), background=(1.0, 0.5, 0.0), modifier=0.05)
    return rounded(out, [*render.COLOURS, "inverse_depth", "transmittance"], 5)


VIEWS = """vw AS (SELECT n_nationkey AS view_id, 24 + n_nationkey AS width, 20::BIGINT AS height, 30.0::DOUBLE + n_regionkey AS fx, cos(n_nationkey * 0.25) AS co, sin(n_nationkey * 0.25) AS si FROM nation)"""


@query(f"""WITH {S}, {ROT}, {VIEWS},
k AS (SELECT *, """ + ", ".join(f"0.0025::DOUBLE * (r{3*i}*r{3*j}*exp(s0)*exp(s0) + r{3*i+1}*r{3*j+1}*exp(s1)*exp(s1) + r{3*i+2}*r{3*j+2}*exp(s2)*exp(s2)) AS k{i}{j}" for i in range(3) for j in range(i, 3)) + """ FROM rot),
p AS (SELECT *, co*x + si*z AS cx, y AS cy, co*z - si*x + 3 AS d FROM k, vw WHERE co*z - si*x + 3 > 0.2),
m AS (SELECT *, fx/d AS j0, -fx*cx/(d*d) AS j2, 28/d AS j4, -28*cy/(d*d) AS j5 FROM p),
w2 AS (SELECT *, j0*co - j2*si AS a0, j0*si + j2*co AS a2, -j5*si AS b0, j4 AS b1, j5*co AS b2 FROM m),
t AS (SELECT view_id, width, height, gid, x, y, z, d, opacity, fx*cx/d + (width - 1) / 2.0::DOUBLE AS pu, 28*cy/d + (height - 1) / 2.0::DOUBLE AS pv,
  a0*a0*k00 + a2*a2*k22 + 2*a0*a2*k02 + 0.3::DOUBLE AS xx, b0*b0*k00 + b1*b1*k11 + b2*b2*k22 + 2*(b0*b1*k01 + b0*b2*k02 + b1*b2*k12) + 0.3::DOUBLE AS yy,
  a0*(b0*k00 + b1*k01 + b2*k02) + a2*(b0*k02 + b1*k12 + b2*k22) AS xy FROM w2),
b AS (SELECT *, xx*yy - xy*xy AS det, ceil(3 * sqrt((xx+yy)/2 + sqrt(greatest(((xx+yy)/2)*((xx+yy)/2) - (xx*yy - xy*xy), 0)))) AS rad FROM t),
h AS (SELECT view_id, gid, d, u, v, abs(x) AS red, abs(y) AS green, least(exp(-0.5::DOUBLE * (yy/det*(u-pu)*(u-pu) + xx/det*(v-pv)*(v-pv)) + xy/det*(u-pu)*(v-pv)) / (1 + exp(-opacity)), 0.99) AS a
  FROM b, range(48) p(u), range(20) q(v) WHERE u < width AND u // 16 BETWEEN floor((pu-rad)/16) AND floor((pu+rad)/16) AND v // 16 BETWEEN floor((pv-rad)/16) AND floor((pv+rad)/16)),
l AS (SELECT *, sum(ln(1 - a)) OVER (PARTITION BY view_id, u, v ORDER BY d, gid) AS after FROM h WHERE a >= 1.0::DOUBLE / 255),
e AS (SELECT view_id, u, v, sum(a * exp(after) / (1 - a) * red) AS red, sum(a * exp(after) / (1 - a) * green) AS green, exp(min(after)) AS left_ FROM l WHERE exp(after) >= 0.01 GROUP BY 1, 2, 3)
SELECT vw.view_id, q.v::INT AS v, count(*) AS pixels, round(avg(least(coalesce(red, 0) + coalesce(left_, 1), 1)), 5) AS red, round(avg(least(coalesce(green, 0), 1)), 5) AS green, round(avg(coalesce(left_, 1)), 5) AS transmittance
FROM vw CROSS JOIN range(48) p(u) CROSS JOIN range(20) q(v) LEFT JOIN e ON e.view_id = vw.view_id AND e.u = p.u AND e.v = q.v WHERE p.u < width GROUP BY 1, 2""")
def render_all_views(spark, sf):
    """A view for each nation, all at once, with early stop; means over the lines of the images."""
    rows = splats(spark, sf).withColumns({c: F.abs(k) for c, k in zip(render.COLOURS, "xyz", strict=True)})
    turn, zero = F.col("n_nationkey") * 0.25, d(0.0)
    views_ = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("view_id"), (F.col("n_nationkey") + 24).alias("width"), F.lit(20).alias("height"), (d(30.0) + F.col("n_regionkey")).alias("fx"), d(28.0).alias("fy"),
        F.array(F.cos(turn), zero, F.sin(turn), zero, d(1.0), zero, -F.sin(turn), zero, F.cos(turn)).alias("r"), F.array(zero, zero, d(3.0)).alias("t"),
    )
    shown = render.render_views(rows, views_, "view_id", background=(1.0, 0.0, 0.0), modifier=0.05, stop=0.01)
    out = shown.groupBy("view_id", "v").agg(F.count("*").alias("pixels"), *(F.avg(c).alias(c) for c in ("red", "green", "transmittance")))
    return rounded(out, ["red", "green", "transmittance"], 5)


@query(f"""WITH {S}, t AS (SELECT gid, (x + 1) * 100 AS px, (y + 1) * 60 AS py, gid % 30 AS radius FROM s),
b AS (SELECT *, greatest(floor((px - radius) / 16), 0)::INT AS x0, least(floor((px + radius) / 16), 12)::INT AS x1, greatest(floor((py - radius) / 16), 0)::INT AS y0, least(floor((py + radius) / 16), 7)::INT AS y1 FROM t WHERE radius > 0)
SELECT gid, tx AS tile_x, ty AS tile_y FROM b, range(0, 13) a(tx), range(0, 8) c(ty) WHERE tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1""")
def splat_tiles(spark, sf):
    rows = splats(spark, sf).select("gid", ((F.col("x") + 1) * 100).alias("px"), ((F.col("y") + 1) * 60).alias("py"), (F.col("gid") % 30).alias("radius"))
    return metrics.tiles(rows, 200, 120).select("gid", "tile_x", "tile_y")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, round(sum(0.4::DOUBLE * 0.6::DOUBLE ** (a.i - b.i) * b.value), 4) AS ema FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1""")
def ema_loss(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("ts").alias("t"), "event_id", "value")
    return metrics.smoothed(rows, ["user_id"], ["t", "event_id"], "value").select("event_id", r(F.col("ema"), 4).alias("ema"))


@query(f"WITH {S} SELECT least(floor(1/(1+exp(-opacity * 20)) * 25), 24)::INT AS bin, count(*) AS n FROM s GROUP BY 1")
def opacity_hist(spark, sf):
    return metrics.histogram(splats(spark, sf), maths.sigmoid(F.col("opacity") * 20), 25)


# ---- structure and text


@query("SELECT conv_id, turn AS place, length(text) AS size FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn, text FROM conversations)")
def nest_unnest(spark, sf):
    nested = structure.nest(table(spark, sf, "conversations"), ["conv_id"], "turn", ["role", "text"], "turns")
    out = structure.unnest(nested, "turns", "place")
    return out.select("conv_id", F.col("place").cast("long").alias("place"), F.length("text").cast("long").alias("size"))


@query("SELECT round(coalesce(avg(n), 0), 6) AS mean_size FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)")
def track_stats(spark, sf):
    tracks = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return rounded(tracks.agg(F.coalesce(F.avg("n"), d(0.0)).alias("mean_size")), ["mean_size"])


@query(f"WITH {S} SELECT gid, round(v[10 + 2], 6) AS rest_2, round(v[10 + 10], 6) AS rest_10, round(v[10 + 3 + 15], 6) AS green_3, round(v[62], 6) AS rot_3 FROM s")
def wide_array(spark, sf):
    wide = splats(spark, sf).select("gid", *(F.col("v")[i].alias(n) for i, n in enumerate(structure.SPLAT_COLUMNS)))
    packed = structure.to_arrays(wide, ["f_rest", "rot", "scale", "f_dc"])
    packed = packed.withColumn("coef", structure.by_coefficient())
    flat = structure.to_columns(packed.select("gid", "f_rest", "rot", "coef"), {"f_rest": 45, "rot": 4})
    return flat.select("gid", r(F.col("f_rest_2")).alias("rest_2"), r(F.col("f_rest_10")).alias("rest_10"), r(F.col("coef")[3][1]).alias("green_3"), r(F.col("rot_3")).alias("rot_3"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(url, '\.[^./]*$', '') AS stem, lpad(page_id::VARCHAR, 8, '0') || '.png' AS numbered FROM pages""")
def path_stem(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.base_name(url).alias("base"), text.stem(url).alias("stem"), text.numbered(F.col("page_id"), 8).alias("numbered"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def json_params(spark, sf):
    rows = files.keyed_values(table(spark, sf, "events").select("event_id", "props"), "props", "bigint")
    return rows.filter("name = 'k'").select("event_id", F.col("value").alias("k"))


@query("""SELECT n_nationkey, count(*) AS requests, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0 GROUP BY 1""")
def viewer_requests(spark, sf):
    row = F.struct((F.col("s_suppkey") % 10).cast("int").alias("resolution_x"), F.lit(5).alias("resolution_y"), F.col("s_acctbal").alias("scaling_modifier"), F.col("s_nationkey").cast("double").alias("fov_x"))
    got = requests.parse(table(spark, sf, "supplier").select(F.to_json(row).alias("value")))
    return got.groupBy(F.col("fov_x").cast("int").alias("n_nationkey")).agg(F.count("*").alias("requests"), F.round(F.sum("scaling_modifier"), 2).alias("total"))


@query("""WITH q AS (SELECT user_id, ts, event_id, event_id % 7 <> 0 AS sized, event_type <> 'error' AS train, event_type IN ('view', 'click') AS keep FROM events),
w AS (SELECT *, row_number() OVER c AS n, coalesce(sum(train::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lag(ts) OVER c AS since FROM q WINDOW c AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, train AND (before < 20 OR NOT keep) AS go FROM w),
i AS (SELECT *, sum(go::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration FROM g)
SELECT user_id, 'request' AS event, n, sized AS image, go AS released, iteration::BIGINT AS iteration, NOT go AS waiting FROM i
UNION ALL SELECT user_id, 'lost', n - 1, false, false, (iteration - go::INT)::BIGINT, false FROM i WHERE ts > since + INTERVAL 6 HOUR""")
def viewer_sessions(spark, sf):
    """Events stand in for the requests of viewers; what the stateful stream answers, on a table."""
    kind = F.col("event_type")
    asked = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("t"), F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("width"), F.lit(5).alias("height"), (kind != "error").alias("train"), kind.isin("view", "click").alias("keep_alive"))
    out = control.answers(asked, 20, "6 hours")
    return out.select(F.col("client").alias("user_id"), "event", "n", "image", "released", "iteration", "waiting")


@query("SELECT event_type, rank, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def first_k(spark, sf):
    return metrics.first_k(table(spark, sf, "events"), ["event_type"], [F.desc("value"), "event_id"], 5).select("event_type", "rank", "event_id")


@query("SELECT gid, round(dist, 4) AS z FROM (SELECT vec_id AS gid, (embedding[1]::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE AS dist FROM embeddings)")
def z_score(spark, sf):
    return splats(spark, sf).select("gid", r(metrics.z_score(F.col("x"), 0.485, 0.229), 4).alias("z"))


@query("SELECT user_id, round((max(epoch_us(ts) + (value * 1000000)::BIGINT) - min(epoch_us(ts))) / 1000000.0::DOUBLE, 2) AS elapsed, round(sum((value * 1000000)::BIGINT) / 1000000.0::DOUBLE, 2) AS busy, count(*) AS runs FROM events GROUP BY 1")
def suite_timing(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", F.timestamp_micros(start).alias("start"), F.timestamp_micros(start + F.round(F.col("value") * 1_000_000).cast("long")).alias("end"))
    return rounded(metrics.elapsed(rows, ["user_id"], "start", "end"), ["elapsed", "busy"], 2)


@query(f"WITH {PAIRS} SELECT vec_id, count(*) FILTER (WHERE a > 0.55::DOUBLE) AS lit FROM pr GROUP BY 1")
def lit_pixels(spark, sf):
    pixels = image_pairs(spark, sf).select("vec_id", "c", "y", "x", (F.col("a") - 0.55).alias("v"))
    return views.lit_mask(pixels, ["vec_id"]).groupBy("vec_id").agg(F.count_if("mask").alias("lit"))


# ---- pieces that files are read with


@query("""SELECT p_partkey, p_size * 10.0::DOUBLE AS fx, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10.0::DOUBLE ELSE p_retailprice END AS fy FROM part""")
def focal_lengths(spark, sf):
    model = F.when(F.col("p_partkey") % 2 == 0, "SIMPLE_PINHOLE").otherwise("PINHOLE")
    fx, fy = views.focal_lengths(model, F.array((F.col("p_size") * 10).cast("double"), F.col("p_retailprice"), d(1.0), d(2.0)))
    return table(spark, sf, "part").select("p_partkey", fx.alias("fx"), fy.alias("fy"))


@query("""WITH t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS idx, count(*) OVER () AS n FROM supplier)
SELECT s_suppkey AS view_key, 'train' AS split FROM t WHERE idx IN (5 % n, 10 % n, 15 % n, 20 % n, 25 % n) UNION ALL SELECT c_custkey, 'test' FROM customer""")
def validation_views(spark, sf):
    train = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("view_key"), F.col("s_name").alias("name"))
    test = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("view_key"), F.lit("").alias("name"))
    return views.validation_views(train, test, ["name", "view_key"]).select("view_key", "split")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY md5('3:' || s_suppkey), s_suppkey) - 1 AS place FROM supplier")
def shuffled_views(spark, sf):
    return views.shuffled(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3)


@query("""SELECT event_id, strftime(ts, '%d/%m %H:%M:%S') AS label, event_id || ',' || (event_id + 2) AS odd, starts_with(trim(event_type), 'v') AS comment, (props->>'$.k')::BIGINT AS renamed FROM events""")
def text_tools(spark, sf):
    rows = table(spark, sf, "events")
    shown = F.when(F.startswith(F.col("event_type"), F.lit("v")), F.concat(F.lit(" # "), "event_type")).otherwise(F.col("event_type"))
    keys = text.renamed_keys(F.from_json("props", "map<string,bigint>"), "k", "key")
    numbers = text.fields(F.concat(F.lit(" "), *(x for i in range(4) for x in ((F.col("event_id") + i).cast("string"), F.lit("  ")))))
    odd = F.array_join(text.every(numbers, 2), ",")
    return rows.select("event_id", text.log_label(F.col("ts")).alias("label"), odd.alias("odd"), text.is_comment(shown).alias("comment"), F.try_element_at(keys, F.lit("key")).alias("renamed"))


@query(f"""WITH {S}, {ROT} SELECT gid, round(r0 / tan(0.5::DOUBLE), 6) AS m00, round(r5 / tan(0.25::DOUBLE), 6) AS m21, round(r6 * 100 / (100 - 0.01::DOUBLE), 6) AS m02, round(z, 6) AS m33, round(-(r0*x + r3*y + r6*z), 6) AS centre FROM rot""")
def full_projection(spark, sf):
    m, p = unit_rotation(), [F.col(c) for c in "xyz"]
    view = [[*m[i], p[i]] for i in range(3)] + [[d(0.0), d(0.0), d(0.0), d(1.0)]]
    full = maths.full_projection(view, maths.projection(0.01, 100.0, d(1.0), d(0.5)))  # row vectors: cell i, j takes world i to clip j
    shown = {"m00": full[0][0], "m21": full[2][1], "m02": full[0][2], "m33": full[3][3], "centre": maths.camera_centre(view)[0]}
    return splats(spark, sf).select("gid", *(r(c).alias(n) for n, c in shown.items()))


@query(f"""WITH {S}, p AS (SELECT a.gid, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM s a JOIN s b ON a.gid <> b.gid),
k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d2) AS n FROM p), m AS (SELECT gid, avg(d2) AS d2 FROM k WHERE n <= 3 GROUP BY 1)
SELECT gid, round(ln(sqrt(greatest(d2, 1e-7))), 4) AS s1, round((abs(x) - 0.5) / (0.5::DOUBLE * sqrt(1 / pi())), 6) AS dc, round(ln(0.1::DOUBLE / 0.9::DOUBLE), 6) AS opacity, 45 AS rest FROM m JOIN s USING (gid)""")
def initial_splats(spark, sf):
    cloud = splats(spark, sf).select("gid", "x", "y", "z", F.abs("x").alias("red"), F.abs("y").alias("green"), F.abs("z").alias("blue"))
    return density.initial(cloud).select("gid", r(F.col("s1"), 4).alias("s1"), r(F.col("f_dc")[0]).alias("dc"), r(F.col("opacity")).alias("opacity"), F.size("f_rest").alias("rest"))
