"""Repeated control steps, uneven and long inputs, and the pieces that join files to tables."""

import json
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import session
from pointloom.functions import maths, permute, text
from pointloom.operators import calibrate, density, metrics, neighbours, render, views
from pointloom.sources import files, sparse

SPLAT = "gid long, x double, y double, z double, opacity double, s0 double, s1 double, s2 double, q0 double, q1 double, q2 double, q3 double"


def test_ids_over_many_control_steps(spark):
    """Steps in each of which the newest splat is cloned: ids stay unique and dense. CONTROL_STEPS=150 runs as many as training has."""
    steps = int(os.environ.get("CONTROL_STEPS", "12"))
    rows = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 3.0, -5.0, -5.0, -5.0, 1.0, 0.0, 0.0, 0.0) for k in range(3)], SPLAT)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        made = 3
        for k in range(steps):
            stats = spark.range(1).select(F.lit(made - 1).cast("long").alias("gid"), F.lit(1.0).alias("grad_accum"), F.lit(1).alias("denom"), F.lit(1).alias("max_radius"))
            rows = session.written(density.control(rows, stats, None, threshold=0.1, extent=100.0, dense=0.01, seed=k).coalesce(1), "step")
            made += 1
        ids = [r.gid for r in rows.select("gid").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(ids) == list(range(3 + steps))


def test_ids_of_split_and_large_parents(spark):
    rows = spark.createDataFrame([(g, 0.0, 0.0, 0.0, 3.0, s, s, s, 1.0, 0.0, 0.0, 0.0) for g, s in ((5, -5.0), ((1 << 62) + 7, 1.0), (9, 1.0))], SPLAT)
    stats = rows.select("gid", F.lit(1.0).alias("grad_accum"), F.lit(1).alias("denom"), F.lit(1).alias("max_radius"))
    out = density.control(rows, stats, None, threshold=0.1, extent=100.0).collect()
    top = (1 << 62) + 7
    assert sorted(r.gid for r in out) == [5, *range(top + 1, top + 6)]
    other = density.control(rows, stats, None, threshold=0.1, extent=100.0, seed=1).collect()
    assert {tuple(r) for r in out} != {tuple(r) for r in other}


def test_quaternions_of_rough_matrices(spark):
    """The nearest rotation in the sense of the largest scalar product, as the singular values give it."""
    rng = np.random.default_rng(3)
    rough = []
    for _ in range(40):
        u, _, vt = np.linalg.svd(rng.normal(size=(3, 3)))
        m = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        rough.append(m + rng.normal(0, 0.05, (3, 3)))
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(rough)] + [(99, None)], "k int, r array<double>")
    got = {r.k: r.q for r in neighbours.rotation_quaternions(df).collect()}
    assert got.pop(99) is None
    for k, m in enumerate(rough):
        u, _, vt = np.linalg.svd(m)
        near = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        back = np.einsum("a,ijab,b->ij", got[k], neighbours.rotation_forms(), got[k])
        assert np.allclose(back, near, atol=1e-9) and got[k][0] >= 0 and math.isclose(np.linalg.norm(got[k]), 1)


def test_overall_median(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 101, 1000):
        v = [rng.choice([rng.random(), 0.5]) for _ in range(n)]
        rows = spark.createDataFrame([(x,) for x in [*v, None]], "v double").repartition(5)
        assert calibrate.overall_median(rows, "v").first().median == (float(np.median(v)) if n else None)


def test_calibration_reads_rows_twice(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, True)], "image string, m double, p double, ok boolean").repartition(2)
    plan = calibrate.calibrate(rows, ["image"], "m", "p", "ok")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_as_of_over_ranges(spark):
    """One capture that goes over all ranges, with poses in few of them, and one without a name."""
    rng = random.Random(2)
    poses = [("s", rng.randrange(20_000), k, k) for k in range(6)] + [(None, 10, 7, 7)]
    frames = [("s", rng.randrange(20_000), k) for k in range(5000)] + [(None, 9, 1), (None, 11, 2)]
    got = views.as_of(spark.createDataFrame(frames, "s string, t long, id long").repartition(8), spark.createDataFrame(poses, "s string, t long, id long, pose int"), ["s"], "t", "id", ["pose"]).collect()
    want = {}
    for s, t, k in frames:
        before = [(p[1], p[2], p[3]) for p in poses if p[0] == s and p[1] <= t]
        if before:
            want[s, k] = (max(before)[0], max(before)[2])
    assert {(r.s, r.id): (r.pose_time, r.pose) for r in got} == want and len(got) == len(want)


def test_render_hot_tile(spark):
    """Thousands of splats on one tile lie in several ranges, whose layers are put together in order."""
    rng = np.random.default_rng(5)
    n = 3000
    data = [(k, float(rng.normal(0, 0.02)), float(rng.normal(0, 0.02)), float(rng.uniform(0, 9)), -4.0, -3.0, -3.0, -3.0, 1.0, 0.0, 0.0, 0.0, *map(float, rng.random(3))) for k in range(n)]
    rows = spark.createDataFrame(data, SPLAT + ", red double, green double, blue double").repartition(8)
    view = render.View(16, 16, 20.0, 20.0, translation=(0.0, 0.0, 1.0))
    projected = session.written(render.project(rows, view).withColumn("inverse_depth", 1 / F.col("depth")), "projected")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be one task
    try:
        shown = {(r.u, r.v): r for r in render.render(rows, view).collect()}
        shaded = projected.withColumn("alpha", maths.sigmoid(F.col("opacity")))
        assert render.layers(shaded, view, [*render.COLOURS, "inverse_depth"]).groupBy("u", "v").count().agg(F.max("count")).first()[0] > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hits = render.coverage(projected, view).select("u", "v", "depth", "gid", "alpha", "inverse_depth", *render.COLOURS)
    want = metrics.composite(hits, ["u", "v"], [*render.COLOURS, "inverse_depth"]).collect()
    assert len(want) > 20
    for r in want:
        s = shown[r.u, r.v]
        assert np.allclose([s.red, s.green, s.blue, s.inverse_depth, s.transmittance], [min(r.red, 1), min(r.green, 1), min(r.blue, 1), r.inverse_depth, r.transmittance], atol=1e-9)


def random_splats(rng, n, deep=False):
    data = [(k, *map(float, rng.normal(0, 0.02 if deep else 0.5, 2)), float(rng.uniform(0, 9) if deep else rng.normal(0, 0.5)), float(rng.normal(-1 if deep else 0, 0.5)), *map(float, rng.normal(-3, 0.3, 3)), *map(float, rng.normal(size=4)), *map(float, rng.random(3))) for k in range(n)]
    return data, SPLAT + ", red double, green double, blue double"


def table_of_views(spark, shots):
    rows = [(k, v.width, v.height, v.fx, v.fy, [x for row in v.rotation for x in row], list(v.translation), e) for k, (v, e) in enumerate(shots)]
    return spark.createDataFrame(rows, "shot int, width int, height int, fx double, fy double, r array<double>, t array<double>, m array<array<double>>")


def test_views_of_a_table_equal_single_renders(spark, tmp_path):
    rng = np.random.default_rng(11)
    data, schema = random_splats(rng, 15)
    rows = spark.createDataFrame(data, schema).repartition(3)
    shots = []
    for k in range(50):
        c, s = math.cos(k / 8), math.sin(k / 8)
        shots.append((render.View(10 + k, 7 + k % 20, 15.0 + k, 14.0, ((c, 0.0, s), (0.0, 1.0, 0.0), (-s, 0.0, c)), (0.1, -0.2, 3.0)), None if k % 3 else [[0.9, 0.0, 0.1, 0.02], [0.0, 1.0, 0.0, 0.0], [0.0, 0.2, 0.8, -0.01]]))
    shots[7] = (render.View(16, 17, 9.0, 9.0, translation=(0.0, 0.0, -50.0)), None)  # all splats behind the camera
    all_views = session.written(render.render_views(rows, table_of_views(spark, shots), "shot", (0.2, 0.4, 0.6), exposure="m"), "shown")
    shown = {}
    for r in all_views.collect():
        shown.setdefault(r.shot, {})[r.u, r.v] = tuple(r)[3:]
    assert {k: len(v) for k, v in shown.items()} == {k: v.width * v.height for k, (v, _) in enumerate(shots)}
    for k in (0, 7, 16, 31, 49):
        one = {(r.u, r.v): tuple(r)[2:] for r in render.render(rows, shots[k][0], (0.2, 0.4, 0.6), shots[k][1]).collect()}
        assert one.keys() == shown[k].keys() and all(np.allclose(one[p], shown[k][p], atol=1e-9) for p in one)
    made = render.write_views(all_views.filter("shot < 4"), F.format_string("test/renders/%05d.png", "shot"), str(tmp_path / "out"))
    assert {r.path for r in made.collect()} == {f"test/renders/{k:05d}.png" for k in range(4)}
    image = files.png_pixels((tmp_path / "out" / "test" / "renders" / "00002.png").read_bytes())
    assert image.shape == (9, 12, 3) and all(abs(image[v, u, 0] / 255 - x[0]) < 0.003 for (u, v), x in shown[2].items())


def test_early_stop_is_the_same_in_any_ranges(spark):
    """Hot tiles over several ranges: a pixel stops where a walk over its splats, one by one, does."""
    rng = np.random.default_rng(6)
    data, schema = random_splats(rng, 1500, deep=True)
    rows = spark.createDataFrame(data, schema).repartition(8)
    view, stop = render.View(20, 16, 20.0, 20.0, translation=(0.0, 0.0, 1.0)), 0.02
    views_ = table_of_views(spark, [(view, None), (render.View(18, 16, 25.0, 20.0, translation=(0.1, 0.0, 1.0)), None)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be one task
    try:
        shown = {(r.u, r.v): r for r in render.render_views(rows, views_, "shot", stop=stop).filter("shot = 0").collect()}
        single = {(r.u, r.v): r for r in render.render(rows, view, stop=stop).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    projected = render.project(rows, view).withColumn("inverse_depth", 1 / F.col("depth"))
    hits: dict = {}
    for r in render.coverage(session.written(projected, "projected"), view).select("u", "v", "depth", "gid", "alpha", "inverse_depth", *render.COLOURS).collect():
        hits.setdefault((r.u, r.v), []).append(r)
    stopped = 0
    for p, r in shown.items():
        left, total = 1.0, np.zeros(4)
        for h in sorted(hits.get(p, []), key=lambda h: (h.depth, h.gid)):
            if left * (1 - h.alpha) < stop:
                stopped += 1
                break
            total += left * h.alpha * np.array([h.red, h.green, h.blue, h.inverse_depth])
            left *= 1 - h.alpha
        want = [*np.clip(total[:3], 0, 1), total[3], left]
        for got in (r, single[p]):
            assert np.allclose([got.red, got.green, got.blue, got.inverse_depth, got.transmittance], want, atol=1e-9)
    assert stopped > 10 and len(shown) == 320


def filtered_png(v, palette=None, depth=8, kinds=(0, 1, 2, 3, 4)):
    """A PNG whose lines use all filters in turn."""
    h, w = v.shape[:2]
    if palette is not None:
        bits = (v.reshape(h, w)[:, :, None] >> np.arange(depth)[::-1]) & 1
        flat, step, colour = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1), 1, 3
    else:
        flat, step, colour = v.reshape(h, -1).astype(np.uint8), v.shape[2], {1: 0, 2: 4, 3: 2, 4: 6}[v.shape[2]]
    lines = b""
    for y in range(h):
        a = np.r_[np.zeros(step, int), flat[y].astype(int)][: flat.shape[1]]
        up = flat[y - 1].astype(int) if y else np.zeros(flat.shape[1], int)
        c = np.r_[np.zeros(step, int), up][: flat.shape[1]]
        p = a + up - c
        paeth = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        how = kinds[y % len(kinds)]
        guess = [np.zeros_like(a), a, up, (a + up) // 2, paeth][how]
        lines += bytes([how]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0))
    extra = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + head + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_filters_and_palettes():
    rng = np.random.default_rng(4)
    for channels in (1, 2, 3, 4):
        for shape in ((11, 7), (1, 9), (9, 1), (5, 5)):
            v = rng.integers(0, 256, (*shape, channels)).astype(np.uint8)
            assert (files.png_pixels(filtered_png(v)) == v).all()
    for depth in (1, 2, 4, 8):
        colours = rng.integers(0, 256, (1 << depth, 3))
        v = rng.integers(0, 1 << depth, (6, 13))
        assert (files.png_pixels(filtered_png(v, colours, depth)) == colours[v]).all()


def test_images_at_another_size(spark, tmp_path):
    flat = np.full((20, 30, 3), 77, np.uint8)
    assert (files.resized(flat, 15, 10) == 77).all() and files.resized(flat, 15, 10).shape == (10, 15, 3)
    ramp = np.repeat(np.arange(0, 240, 2, dtype=np.uint8)[None, :, None], 8, axis=0)
    half = files.resized(ramp, 60, 4)[0, 5:-5, 0].astype(float)
    assert np.abs(half - (np.arange(60) * 4 + 1)[5:-5]).max() <= 1
    (tmp_path / "a.png").write_bytes(files.png_bytes(flat))
    got = files.read_pixels(spark, str(tmp_path / "a.png"), size=lambda w, h: (w // 2, h // 2))
    assert got.count() == 10 * 15 * 3
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0 not decoded here")
    with pytest.raises(Exception, match="b.jpg is a jpg image, and no decoder for jpg was given"):
        files.read_pixels(spark, str(tmp_path / "b.jpg")).collect()
    assert files.read_pixels(spark, str(tmp_path / "b.jpg"), decoders={"jpg": lambda data: np.zeros((2, 2, 1), np.uint8)}).count() == 4


def test_transform_cameras(spark, tmp_path):
    rng = np.random.default_rng(6)
    m = np.eye(4)
    m[:3, :3] = np.linalg.qr(rng.normal(size=(3, 3)))[0] * 1.5  # scaled axes
    m[:3, 3] = rng.normal(size=3)
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 0.7, "frames": [{"file_path": "./train/r_0", "transform_matrix": m.tolist()}]}))
    (tmp_path / "r_0.png").write_bytes(files.png_bytes(np.zeros((30, 40, 3), np.uint8)))
    sizes = files.image_sizes(spark, str(tmp_path / "*.png"))
    got = files.transform_cameras(files.read_transforms(spark, str(tmp_path / "t.json")), sizes, is_test=True).first()
    flipped = m.copy()
    flipped[:3, 1:3] *= -1
    inverse = np.linalg.inv(flipped)
    assert np.allclose(np.array(got.R).reshape(3, 3), inverse[:3, :3].T) and np.allclose(got["T"], inverse[:3, 3])
    assert (got.width, got.height, got.is_test) == (40, 30, True)
    assert math.isclose(got.fov_y, 2 * math.atan(30 / (2 * (40 / (2 * math.tan(0.35))))))


def test_depth_pipeline_from_model_to_parameters(spark):
    """Observations of a model, their validity, calibration by view and the parameters' JSON."""
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(k, *map(float, rng.normal(0, 0.3, 3)), 0, 0, 0, 0.0, []) for k in range(60)], sparse.POINT)
    seen = [(float(x), float(y), k) for k, (x, y) in enumerate(rng.uniform(-20, 120, (60, 2)))]
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 2.0], 1, "v1.png", seen)], sparse.IMAGE)
    eye = F.array(*(F.lit(float(i == j)) for i in range(3) for j in range(3)))
    rows = views.observations(images, points).join(images.select("image_id", "name", F.col("tvec").alias("t")), "image_id").withColumn("r", eye)
    out = views.observed_depth(rows, 100, 80)
    truth = {r.point3d_id: (r.x, r.y, r.z) for r in points.collect()}
    for r in out.collect():
        z = truth[r.point3d_id][2] + 2
        assert math.isclose(r.invdepth, 1 / z) and r.valid == (0 <= r.x < 100 and 0 <= r.y < 80 and z > 0)
    out = out.withColumn("prior", F.col("invdepth") * 4 + 1)
    params = calibrate.calibrate(out.withColumn("stem", text.stem(F.col("name"))), ["stem"], "invdepth", "prior", "valid")
    back = json.loads(files.keyed_json(params, "stem", F.struct("scale", "offset")).first().json)
    assert math.isclose(back["v1"]["scale"], 0.25, rel_tol=1e-6) and math.isclose(back["v1"]["offset"], -0.25, rel_tol=1e-6)


def test_capture_export(spark, tmp_path):
    poses = spark.createDataFrame([("s", 30, 0, [0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0]), ("s", 60, 1, [1.0, 0.0, 0.0, 0.0], [4.0, 5.0, 6.0])], "scene string, t long, id long, q array<double>, pos array<double>")
    frames = spark.createDataFrame([("s", t, k) for k, t in enumerate([10, 30, 70])], "scene string, t long, id long")
    placed = views.capture_frames(frames, poses, ["scene"], "t", "id", ["q", "pos"]).withColumn("t", F.col("pos"))
    (tmp_path / "s.csv").write_text("uid,graph_uid,px_world,py_world,pz_world\n5,x,1,2,3\n")
    cameras = spark.createDataFrame([(1, "PINHOLE", 10, 10, [1.0, 1.0, 5.0, 5.0])], sparse.CAMERA)
    sparse.export_capture(placed, cameras, files.read_semidense(spark, str(tmp_path / "s.csv")), str(tmp_path / "model"))
    _, images, points = sparse.read_model(spark, str(tmp_path / "model"))
    got = images.orderBy("image_id").collect()
    assert [(r.image_id, r.qvec, r.tvec, r.name) for r in got] == [(1, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], "00001.png"), (2, [0.0, 1.0, 0.0, 0.0], [4.0, 5.0, 6.0], "00002.png")]
    assert tuple(points.first())[:7] == (5, 1.0, 2.0, 3.0, 128, 128, 128)


def test_metric_tables_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([(x / 100,) for x in range(101)], "a double")
    for k in (1, 2):
        files.append_histogram(metrics.histogram(rows, F.col("a"), 4), str(tmp_path / "h"), "run", k, "opacity", 4)
    got = sorted((r.iteration, r.low, r.high, r.n) for r in spark.read.parquet(str(tmp_path / "h")).collect())
    assert got[:4] == [(1, 0.0, 0.25, 25), (1, 0.25, 0.5, 25), (1, 0.5, 0.75, 25), (1, 0.75, 1.0, 26)] and len(got) == 8
    png = files.png_bytes(np.zeros((2, 2, 3), np.uint8))
    files.append_images(spark.createDataFrame([("r", 7, "test_view_a/render", bytearray(png))], "run string, iteration int, tag string, png binary"), str(tmp_path / "i"))
    assert bytes(spark.read.parquet(str(tmp_path / "i")).first().png) == png
    files.write_timing(spark.createDataFrame([("m360", 90.0), ("db", 30.0)], "suite string, elapsed double"), "suite", str(tmp_path / "timing"))
    assert [r.value for r in spark.read.text(str(tmp_path / "timing")).collect()] == ["db: 0.5 minutes", "m360: 1.5 minutes"]
    assert files.read_settings(spark, str(tmp_path / "cfg")) == {}
    files.write_settings(spark, {"b": 1, "a": None}, str(tmp_path / "cfg"))
    assert views.override({"b": 2, "c": None}, files.read_settings(spark, str(tmp_path / "cfg"))) == {"a": None, "b": 2}
    assert views.hold_out_step("data/360_v2/garden", 0) == 8 and views.hold_out_step("data/truck", 0) == 0
    names = spark.createDataFrame([("run 1",), ("run 2",)], "k string").select(text.run_id(F.col("k")).alias("id")).collect()
    assert len({r.id for r in names}) == 2 and all(len(r.id) == 10 for r in names)


def test_ply_is_read_in_ranges(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("gid"), (F.col("id") * 0.5).alias("x"))
    for k in range(2):
        files.write_ply(rows, {"x": "double"}, str(tmp_path / f"m{k}.ply"))
    got = files.read_ply(spark, str(tmp_path / "*.ply"), ["x"], rows_per_task=300)
    assert got.count() == 2000 and got.filter("x <> gid * 0.5").count() == 0 and got.rdd.getNumPartitions() == 8
    assert not [p for p in tmp_path.iterdir() if ".tmp" in p.name]


def test_shared_folder(spark, tmp_path):
    path = session.fresh_folder(spark, "case")
    session.written(spark.range(3), "case")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.qualified(spark, str(tmp_path)) == f"file://{tmp_path}" and session.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"

    class Elsewhere:
        """A session of a cluster without the setting."""

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="must name a folder"):
        session.shared_folder(Elsewhere)


def test_adam_keeps_what_is_not_visible(spark):
    rows = spark.createDataFrame([(1.0, 0.5, 0.0, 0.0, True), (1.0, 0.5, 0.0, 0.0, False)], "x double, grad_x double, m_x double, v_x double, seen boolean")
    a, b = maths.adam_groups(rows, {"xyz": (["x"], 0.1)}, 1, F.col("seen")).orderBy(F.desc("seen")).collect()
    assert math.isclose(a.x, 0.9) and math.isclose(a.m_x, 0.05) and (b.x, b.m_x, b.v_x) == (1.0, 0.0, 0.0)


def brute_neighbours(p, k):
    out = []
    for i in range(len(p)):
        d2 = np.sort(((np.delete(p, i, axis=0) - p[i]) ** 2).sum(axis=1))[:k]
        out.append(float(d2.mean()) if len(d2) else 0.0)
    return out


@pytest.mark.parametrize(("block", "fan"), [(4, 3), (32, 64)])
def test_neighbours_by_levels(spark, monkeypatch, block, fan):
    """A tree of several levels over clusters, outliers, equal points and a plane: exact, and joined by equality only."""
    monkeypatch.setattr(neighbours, "FAN", fan)
    rng = np.random.default_rng(block)
    p = np.concatenate([rng.normal(0, 1e-3, (150, 3)), rng.normal(5, 2, (150, 3)), [[1e9, -1e9, 1e9], [-1e12, 0, 0]], np.repeat(rng.random((3, 3)), 20, axis=0), np.c_[rng.random((80, 2)), np.zeros(80)]])
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "gid long, x double, y double, z double").repartition(4)
    out = neighbours.mean_distance2(rows, 3, block)
    assert np.allclose([r.dist2 for r in out.orderBy("gid").collect()], brute_neighbours(p, 3), rtol=1e-9)
    plans = []
    monkeypatch.setattr(neighbours, "written", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or session.written(df, what))
    neighbours.mean_distance2(rows, 3, block)
    assert plans and not any("NestedLoop" in t or "Cartesian" in t for t in plans)
    assert len(neighbours.levels(neighbours.written(spark.range(100).select(F.col("id").alias("block"), *(F.lit(0.0).alias(f"{n}_{c}") for c in "xyz" for n in ("low", "high"))), "b"), 100)) == (5 if fan == 3 else 2)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 10, 97, 100, 1000, 4099):
        for seed in (0, 5):
            x, key = np.arange(n), permute.key_of(np.full(n, 3), seed)
            y = permute.permuted(x, key, n)
            assert sorted(y) == list(range(n)) and (permute.permuted(y, key, n, back=True) == x).all()
    orders = [permute.permuted(np.arange(300), permute.key_of(np.full(300, e), 1), 300) for e in range(40)]
    assert len({tuple(o) for o in orders}) == 40
    # every view comes early and late alike
    assert abs(np.mean([np.flatnonzero(o == 17)[0] for o in orders]) - 150) < 60 and np.std([o[0] for o in orders]) > 50
    with pytest.raises(ValueError):
        permute.permuted(np.array([5]), np.array([0]), 5)
    rows = spark.createDataFrame([(0, 1), (4, 1), (None, 1), (2, None)], "slot long, epoch long")
    got = rows.select(permute.place(F.col("slot"), F.col("epoch"), 5).alias("v")).collect()
    assert got[2].v is None and got[3].v is None and {0 <= r.v < 5 for r in got[:2]} == {True}


def test_training_log(spark):
    named = spark.createDataFrame([(f"v{k:03d}",) for k in range(37)], "name string").repartition(3)
    log = views.training_log(spark.range(0, 37 * 6).withColumnRenamed("id", "it"), named, "name", 9)
    assert "Sort [epoch" not in log._jdf.queryExecution().optimizedPlan().toString()
    drawn: dict = {}
    for r in log.collect():
        assert (r.epoch, r.slot) == divmod(r.it, 37)
        drawn.setdefault(r.epoch, {})[r.slot] = r.name
    assert all(sorted(e.values()) == [f"v{k:03d}" for k in range(37)] for e in drawn.values()) and len({tuple(sorted(e.items())) for e in drawn.values()}) == 6
    order = views.epoch_order(named, spark.range(6).withColumnRenamed("id", "epoch"), "name", 9).collect()
    assert len(order) == 222 and all(drawn[r.epoch][r.slot] == r.name for r in order)
    with pytest.raises(ValueError, match="no views"):
        views.training_log(log.select("it"), named.limit(0), "name")
