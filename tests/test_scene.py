"""Codecs round-trip, operators on small fixtures, and properties."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import harmonics, maths, text
from pointloom.operators import calibrate, density, metrics, neighbours, render, structure, views
from pointloom.sources import files, sparse
from pointloom.streaming import requests


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    cameras = [(1, "SIMPLE_PINHOLE", 640, 480, [500.0, 320.0, 240.0]), (2, "PINHOLE", 1000, 800, [700.5, 701.0, 500.0, 400.0])]
    images = [(i, [1.0, 0.1 * i, 0.0, 0.0], [0.0, float(i), 2.5], 1 + i % 2, f"v{i}é.png", [(rng.random() * 600, rng.random() * 400, rng.choice([-1, k, 45])) for k in range(5 * (i % 4))]) for i in range(1, 10)]
    points = [(k, k * 0.5, -1.0 * k, 3.25, k, 2 * k, 255 - k, 0.125, [(1, k), (2, 0)][: k % 3]) for k in range(40) if k != 7]
    return (spark.createDataFrame(cameras, sparse.CAMERA), spark.createDataFrame(images, sparse.IMAGE), spark.createDataFrame(points, sparse.POINT))


def same(a, b, key):
    assert a.columns == b.columns
    assert a.orderBy(key).collect() == b.orderBy(key).collect()


@pytest.mark.parametrize("ext", ["bin", "txt"])
def test_model_round_trip(spark, model, tmp_path, ext):
    sparse.write_model(*model, str(tmp_path), ext)
    assert sparse.model_format(spark, str(tmp_path)) == ext
    for a, b, key in zip(model, sparse.read_model(spark, str(tmp_path)), ("camera_id", "image_id", "point3d_id"), strict=True):
        same(a, b, key)


def test_binary_layout(model, tmp_path):
    sparse.write_model(*model, str(tmp_path), "bin")
    data = (tmp_path / "cameras.bin").read_bytes()
    assert struct.unpack_from("<QiiQQ3d", data) == (2, 1, 0, 640, 480, 500.0, 320.0, 240.0)
    with pytest.raises(FileNotFoundError):
        sparse.model_format(model[0].sparkSession, str(tmp_path / "none"))


def test_text_with_comments_and_blank_lines(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# head\n\n1 1 0 0 0 0 0 0 3 a b.png\n\n# more\n2 1 0 0 0 0 0 0 3 b.png\n1 2 -1 3 4 5\n")
    got = sparse.read_images_text(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(r.name, len(r.points2d)) for r in got] == [("a", 0), ("b.png", 2)]


def test_dense_map(spark, tmp_path):
    v = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "d.bin").write_bytes(b"3&2&1&" + v.T[:, :, None].tobytes(order="F"))
    got = {(r.y, r.x): r.v for r in sparse.read_dense(spark, str(tmp_path / "d.bin")).collect()}
    assert got == {(y, x): float(v[y, x]) for y in range(2) for x in range(3)}


def test_ply(spark, tmp_path):
    rows = spark.createDataFrame([(k, *(float(k * 100 + i) for i in range(62))) for k in range(3)], ", ".join(["gid long", *(f"{c} double" for c in structure.SPLAT_COLUMNS)]))
    files.write_splats(rows, str(tmp_path / "m.ply"))
    same(rows, files.read_ply(spark, str(tmp_path / "m.ply"), structure.SPLAT_COLUMNS), "gid")
    cloud = files.random_cloud(spark, 200).withColumns({c: F.floor(F.col(c) * 255) for c in ("red", "green", "blue")})
    files.write_point_cloud(cloud, str(tmp_path / "c.ply"))
    assert files.read_point_cloud(spark, str(tmp_path / "c.ply")).filter("abs(x) <= 1.3 and red between 0 and 1 and nx = 0").count() == 200
    assert text.in_suffix_order(["f_10", "f_9", "g_1"], "f") == ["f_9", "f_10"]


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png(spark, tmp_path, channels):
    v = np.random.default_rng(1).integers(0, 256, (7, 5, channels)).astype(np.uint8)
    data = files.png_bytes(v)
    assert (files.png_pixels(data) == v).all()
    (tmp_path / "i.png").write_bytes(data)
    pixels = files.read_pixels(spark, str(tmp_path / "i.png"))
    assert pixels.count() == v.size
    assert bytes(files.encode_png(pixels, ["path"]).first().png) == data
    pnm = b"P5 5 7 255\n" + v[:, :, 0].tobytes()
    assert (files.pnm_pixels(pnm)[:, :, 0] == v[:, :, 0]).all()


def test_json_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"camera_angle_x": 0.5, "frames": [{"file_path": "./train/r_0", "transform_matrix": np.arange(16.0).reshape(4, 4).tolist()}]}))
    frame = files.read_transforms(spark, str(tmp_path / "t.json")).first()
    assert frame.image_name == "r_0" and frame.file_path.endswith("r_0.png") and frame.c2w[1] == [4.0, -5.0, -6.0, 7.0]
    params = {"a": {"scale": 1.5, "offset": 0.0}, "b": {"scale": 2.0, "offset": -1.0}}
    (tmp_path / "p.json").write_text(json.dumps(params))
    rows = files.read_depth_params(spark, str(tmp_path / "p.json"))
    back = files.keyed_json(rows, "stem", F.struct("scale", "offset")).first().json
    assert json.loads(back) == params
    (tmp_path / "e.json").write_text(json.dumps({"v1": [[1, 0, 0, 0.5]] * 3}))
    assert files.read_exposures(spark, str(tmp_path / "e.json")).first().m[0] == [1.0, 0.0, 0.0, 0.5]
    (tmp_path / "n.txt").write_text("b.png\n\n a.png \n")
    assert {r.name for r in files.read_names(spark, str(tmp_path / "n.txt")).collect()} == {"a.png", "b.png"}
    (tmp_path / "s.csv").write_text("uid,graph_uid,px_world,py_world,pz_world\n5,x,1,2,3\n")
    assert files.read_semidense(spark, str(tmp_path / "s.csv")).first().z == 3.0


def test_versions(spark, tmp_path):
    for k in (0, 7000, 30000):
        files.write_version(spark.range(k // 1000 + 1), str(tmp_path / "v"), k)
    assert files.latest(spark, str(tmp_path / "v")).count() == 31
    assert files.latest(spark, str(tmp_path / "v"), 0).count() == 1


def test_model_views(spark, model):
    cameras, images, points = model
    joined = views.with_camera(images, cameras)
    fx, fy = views.focal_lengths(F.col("model"), F.col("params"))
    assert {(r.a, r.b) for r in joined.select(fx.alias("a"), fy.alias("b")).collect()} == {(500.0, 500.0), (700.5, 701.0)}
    with pytest.raises(Exception, match="no camera"):
        views.with_camera(images, cameras.filter("camera_id = 1")).collect()
    with pytest.raises(Exception, match="not supported"):
        spark.createDataFrame([("OPENCV", [1.0])], "model string, params array<double>").select(fx).collect()
    seen = views.observations(images, points)
    assert seen.filter("point3d_id < 0 or point3d_id > 39").count() == 0
    gap = spark.createDataFrame([(1, [0.0], [0.0], 1, "n", [(1.0, 1.0, 7)])], sparse.IMAGE)
    assert views.observations(gap, points).select("px", "gap").first() == (0.0, True)


def test_hold_out(spark):
    names = [f"n{k:02d}" for k in range(17)]
    random.Random(0).shuffle(names)
    got = views.hold_out(spark.createDataFrame([(n,) for n in names], "name string"), ["name"])
    assert sorted(r.name for r in got.filter("is_test").collect()) == ["n00", "n08", "n16"]
    assert views.hold_out(got.select("name"), ["name"], 0).filter("is_test").count() == 0
    assert views.hold_out(got.select("name").limit(0), ["name"]).count() == 0


def test_calibration_rules(spark):
    rng = random.Random(0)
    rows = []
    for image, n in (("twelve", 12), ("ten", 10)):
        rows += [(image, 2 * p + 0.5, p, True) for p in (rng.random() for _ in range(n))]
    rows += [("flat", 0.5 + k * 1e-6, rng.random(), True) for k in range(20)] + [("none", 1.0, 1.0, False)]
    got = {r.image: (r.scale, r.offset) for r in calibrate.calibrate(spark.createDataFrame(rows, "image string, m double, p double, ok boolean"), ["image"], "m", "p", "ok").collect()}
    assert got["ten"] == got["flat"] == got["none"] == (0.0, 0.0)
    assert math.isclose(got["twelve"][0], 2.0) and math.isclose(got["twelve"][1], 0.5)
    params = spark.createDataFrame([(s,) for s in (-1.0, 0.0, 1.0, 1.0, 1.0, 0.19, 5.1, None)], "scale double")
    flags = {r.scale: r.reliable for r in calibrate.gate(params).collect()}
    assert flags == {-1.0: False, 0.0: False, 1.0: True, 0.19: False, 5.1: False, None: True}


def splats(spark):
    # small with large gradient, large with large gradient, small quiet, transparent, unseen, oversized
    rows = [(0, -5.0, 3.0), (1, 1.0, 3.0), (2, -5.0, 3.0), (3, -5.0, -9.0), (4, -5.0, 3.0), (5, 3.0, 3.0)]
    return spark.createDataFrame([(g, 0.0, 0.0, 0.0, o, s, s, s, 1.0, 0.0, 0.0, 0.0) for g, s, o in rows], "gid long, x double, y double, z double, opacity double, s0 double, s1 double, s2 double, q0 double, q1 double, q2 double, q3 double")


def test_density_control(spark):
    stats = spark.createDataFrame([(0, 1.0, 2, 5), (1, 1.0, 2, 5), (2, 0.0, 4, 5), (3, 0.0, 0, 0), (5, 0.0, 1, 99)], "gid long, grad_accum double, denom long, max_radius int")
    out = density.control(splats(spark), stats, None, threshold=0.1, extent=100.0, dense=0.01).collect()
    assert len(out) == 6 + 1 + 2 - 1 - 1  # a clone, two children, their parent, the transparent one
    assert len({r.gid for r in out}) == len(out)
    again = density.control(splats(spark).repartition(7), stats, None, threshold=0.1, extent=100.0, dense=0.01).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    sized = density.control(splats(spark), stats, None, threshold=0.1, extent=100.0, dense=0.01, size_limit=20.0, compat=False)
    assert 5 not in {r.gid for r in sized.collect()}
    assert density.control(splats(spark).limit(0), stats.limit(0), None).count() == 0
    grads = {r.gid: r.grad for r in density.with_gradient(splats(spark), stats).collect()}
    assert grads[3] == 0.0 and grads[4] == 0.0 and grads[0] == 0.5


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(0, 0.001, (200, 3)), [[900.0, 0, 0], [0, 0, 0], [0, 0, 0]]])
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    want = np.sort(d2, axis=1)[:, :3].mean(axis=1)
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "gid long, x double, y double, z double")
    got = neighbours.mean_distance2(rows).toPandas().set_index("gid")["dist2"].sort_index().to_numpy()
    assert np.allclose(got, want)
    assert neighbours.mean_distance2(rows.limit(0)).count() == 0
    assert neighbours.mean_distance2(rows.limit(1)).first().dist2 == 0


def test_neighbours_uneven(spark):
    """A far outlier, a third of the points at one place, a dense and a sparse cloud: no cell may hold all of them."""
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 1e-3, (10_000, 3)), np.full((10_000, 3), 0.5), rng.normal(0, 50, (9_990, 3)), [[1e9, -1e9, 3.0]], [[7.0, 7, 7]] * 2])
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pts.tolist())] + [(-1, None, 0.0, 0.0)], "gid long, x double, y double, z double").repartition(8)
    got = {r.gid: r.dist2 for r in neighbours.mean_distance2(rows).collect()}
    assert len(got) == len(pts) + 1 and got.pop(-1) is None
    for k in [*range(0, len(pts), 300), *range(29_980, len(pts))]:
        d2 = ((pts - pts[k]) ** 2).sum(axis=1)
        d2[k] = np.inf
        assert math.isclose(got[k], np.sort(np.partition(d2, 3)[:3]).mean(), rel_tol=1e-9)


def test_smoothed_hot_user(spark):
    """A user whose rows go over all ranges, one with few, one without a name, and one with a NULL value."""
    rng = random.Random(4)
    rows = [("hot", k, rng.gauss(0, 1)) for k in range(60_000)] + [(u, k, float(k)) for u in (None, "a", "z") for k in range(5)] + [("n", 0, 1.0), ("n", 1, None), ("n", 2, 1.0)]
    want, last = {}, {}
    for u, k, x in rows:
        before = last.get(u, 0.0)
        want[u, k] = last[u] = None if x is None or before is None else (1 - 0.999) * x + 0.999 * before
    rng.shuffle(rows)
    out = metrics.smoothed(spark.createDataFrame(rows, "u string, k int, x double").repartition(8), ["u"], ["k"], "x", 0.999)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_rows" not in plan and out.columns == ["u", "k", "ema"]
    got = out.collect()
    assert len(got) == len(want)
    assert all((r.ema is None) == (want[r.u, r.k] is None) and (r.ema is None or math.isclose(r.ema, want[r.u, r.k], abs_tol=1e-9)) for r in got)


def test_track_stats_counts(spark, sf):
    """Tracks are counted, not collected; a row without an image counts, as in the SQL."""
    from pointloom.plans import queries

    assert "collect_list" not in queries.track_stats(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_image_metrics(spark):
    v = np.random.default_rng(2).random((16, 16, 3))
    w = np.clip(v + np.random.default_rng(3).normal(0, 0.1, v.shape), 0, 1)

    def frame(name, img):
        return [(name, c, y, x, float(img[y, x, c])) for y in range(16) for x in range(16) for c in range(3)]

    schema = "image string, c int, y int, x int, v double"
    a, b = spark.createDataFrame(frame("same", v) + frame("noisy", w), schema), spark.createDataFrame(frame("same", v) + frame("noisy", v), schema)
    both = metrics.pairs(a, b, ["image"])
    psnr = {r.image: r.psnr for r in metrics.errors(both, ["image"]).collect()}
    assert psnr["same"] == math.inf and math.isclose(psnr["noisy"], -10 * math.log10(((v - w) ** 2).mean()), rel_tol=1e-9)
    channel = {r.image: r.psnr_channels for r in metrics.channel_psnr(both.filter("image = 'noisy'"), ["image"]).collect()}
    assert math.isclose(channel["noisy"], np.mean([-10 * np.log10(((v - w)[:, :, c] ** 2).mean()) for c in range(3)]), rel_tol=1e-9)
    k = np.outer(maths.gaussian_window(), maths.gaussian_window())

    def blur(img):
        p = np.pad(img, 5)
        return np.array([[(p[y : y + 11, x : x + 11] * k).sum() for x in range(16)] for y in range(16)])

    total = []
    for c in range(3):
        p, q = w[:, :, c], v[:, :, c]
        mp, mq = blur(p), blur(q)
        total.append(((2 * mp * mq + 1e-4) * (2 * (blur(p * q) - mp * mq) + 9e-4) / ((mp**2 + mq**2 + 1e-4) * (blur(p * p) - mp**2 + blur(q * q) - mq**2 + 9e-4))).mean())
    got = {r.image: r.ssim for r in metrics.ssim(both, ["image"]).collect()}
    assert math.isclose(got["same"], 1.0) and math.isclose(got["noisy"], np.mean(total), rel_tol=1e-9)
    assert metrics.unpaired(a, b.filter("image = 'same'"), ["image"]).collect() == [("noisy", "truth")]


def test_composite(spark):
    hits = spark.createDataFrame([(1, 2.0, 5, 0.5, 1.0), (1, 1.0, 9, 0.5, 2.0), (1, 1.0, 3, 0.25, 4.0)], "px int, depth double, gid long, alpha double, red double")
    row = metrics.composite(hits, ["px"], ["red"], background=8.0).first()
    assert math.isclose(row.red, 0.25 * 4 + 0.75 * 0.5 * 2 + 0.375 * 0.5 * 1 + 0.1875 * 8)
    assert math.isclose(row.transmittance, 0.1875)


def test_as_of(spark):
    poses = spark.createDataFrame([("s", t, k, k) for k, t in enumerate([30, 50, 50, 70, 90, 110])], "scene string, t long, id long, pose int")
    frames = spark.createDataFrame([("s", t, k) for k, t in enumerate([10, 20, 30, 45, 50, 60, 75, 90, 100, 999])], "scene string, t long, id long")
    got = {r.t: r.pose for r in views.as_of(frames, poses, ["scene"], "t", "id", ["pose"]).collect()}
    assert got == {30: 0, 45: 0, 50: 2, 60: 2, 75: 3, 90: 4, 100: 4, 999: 5}
    assert 999 not in {r.t for r in views.as_of(frames, poses, ["scene"], "t", "id", ["pose"], tolerance=20).collect()}


def test_rotations_and_harmonics(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in q], "w double, x double, y double, z double")
    m = maths.rotation(*(F.col(c) for c in "wxyz"))
    got = rows.select(*(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)), *(c.alias(f"q{k}") for k, c in enumerate(maths.quaternion(m)))).toPandas().to_numpy()
    r = got[:, :9].reshape(-1, 3, 3)
    assert np.allclose(r @ r.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True) * np.where(q[:, :1] < 0, -1, 1)
    assert np.allclose(got[:, 9:], unit)
    n = 60  # orthonormal over the sphere, up to degree 4
    z, wz = np.polynomial.legendre.leggauss(n)
    phi = np.arange(n) * 2 * np.pi / n
    pts = [(math.sqrt(1 - a * a) * math.cos(p), math.sqrt(1 - a * a) * math.sin(p), a, b * 2 * np.pi / n) for a, b in zip(z, wz, strict=True) for p in phi]
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double, z double, w double")
    base = harmonics.basis(4, F.col("x"), F.col("y"), F.col("z"))
    values = df.select("w", *(b.alias(f"b{k}") for k, b in enumerate(base))).toPandas().to_numpy()
    assert np.allclose(values[:, 1:].T @ (values[:, 1:] * values[:, :1]), np.eye(25), atol=1e-9)


def test_settings_and_requests(spark, tmp_path):
    assert views.override({"a": None, "b": 2}, {"a": 1, "b": 1}) == {"a": 1, "b": 2}
    message = {"resolution_x": 4, "resolution_y": 4, "view_matrix": list(range(16)), "view_projection_matrix": list(range(16)), "scaling_modifier": 1.0}
    df = spark.createDataFrame([(json.dumps(message),), (json.dumps(message | {"resolution_x": 0}),), ("junk",)], "value string")
    got = requests.parse(df).collect()
    assert len(got) == 1 and got[0].view_matrix[:4] == [0.0, -1.0, -2.0, 3.0]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"t": f"2024-01-01T00:00:{s:02d}", "value": json.dumps(message)}) for s in (1, 5, 12, 31)))
    stream = spark.readStream.schema("t timestamp, value string").json(str(tmp_path / "in"))
    q = requests.rates(requests.parse(stream), "t").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.requests for r in spark.table("rates").collect()) == [1, 1, 2]


def test_names_without_extension(spark):
    row = spark.createDataFrame([("a.b.png", "plain", "d.r/x")], "a string, b string, c string").select(*(text.stem(F.col(c)) for c in "abc")).first()
    assert tuple(row) == ("a.b", "plain", "d.r/x")


def test_render_brute_force(spark):
    rng = np.random.default_rng(8)
    data = [(k, *map(float, rng.normal(0, 0.6, 3)), float(rng.normal()), *map(float, rng.normal(-2.5, 0.5, 3)), *map(float, rng.normal(size=4)), *map(float, rng.random(3))) for k in range(12)]
    data[0] = (0, 0.0, 0.0, -9.0, *data[0][4:])  # behind the camera
    names = ["x", "y", "z", "opacity", "s0", "s1", "s2", "q0", "q1", "q2", "q3", "red", "green", "blue"]
    rows = spark.createDataFrame(data, "gid long, " + ", ".join(f"{n} double" for n in names))
    turn = ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0))
    view = render.View(20, 9, 15.0, 14.0, turn, (0.1, -0.2, 3.0))
    exposure = [[0.9, 0.0, 0.1, 0.02], [0.0, 1.0, 0.0, 0.0], [0.0, 0.2, 0.8, -0.01]]
    got = {(r.u, r.v): r for r in render.render(rows, view, (0.2, 0.4, 0.6), exposure).collect()}
    assert len(got) == 180
    rot, shots = np.array(turn), []
    for gid, x, y, z, o, s0, s1, s2, q0, q1, q2, q3, *rgb in data:
        c = rot @ [x, y, z] + view.translation
        if c[2] <= 0.2:
            continue
        w, i, j, k = np.array([q0, q1, q2, q3]) / np.linalg.norm([q0, q1, q2, q3])
        r = np.array([[1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)], [2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)], [2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)]])
        cov = r @ np.diag(np.exp([2 * s0, 2 * s1, 2 * s2])) @ r.T
        jac = np.array([[15 / c[2], 0, -15 * c[0] / c[2] ** 2], [0, 14 / c[2], -14 * c[1] / c[2] ** 2]]) @ rot
        flat = jac @ cov @ jac.T + 0.3 * np.eye(2)
        radius = math.ceil(3 * math.sqrt(np.linalg.eigvalsh(flat)[1]))
        shots.append((c[2], gid, np.array([15 * c[0] / c[2] + 9.5, 14 * c[1] / c[2] + 4.0]), np.linalg.inv(flat), radius, 1 / (1 + math.exp(-o)), np.array([*rgb, 1 / c[2]])))
    for (u, v), r in got.items():
        left, total = 1.0, np.zeros(4)
        for _, _, at, inverse, radius, o, value in sorted(shots, key=lambda t: t[:2]):
            if any(not math.floor((a - radius) / 16) <= p // 16 <= math.floor((a + radius) / 16) for p, a in zip((u, v), at, strict=True)):
                continue
            away = np.array([u, v]) - at
            alpha = min(o * math.exp(-0.5 * away @ inverse @ away), 0.99)
            if alpha >= 1 / 255:
                total += left * alpha * value
                left *= 1 - alpha
        rgb = total[:3] + left * np.array([0.2, 0.4, 0.6])
        e = np.array(exposure)
        want = np.clip(rgb @ e[:, :3] + e[:, 3], 0, 1)
        assert np.allclose([r.red, r.green, r.blue, r.inverse_depth, r.transmittance], [*want, total[3], left], atol=1e-9)
    assert {tuple(r)[2:] for r in render.render(rows.limit(0), view).collect()} == {(0.0, 0.0, 0.0, 0.0, 1.0)}


def test_state_and_initial_splats(spark):
    stats = spark.createDataFrame([(0, 1.0, 2, 5), (1, 1.0, 2, 5)], "gid long, grad_accum double, denom long, max_radius int")
    rows = splats(spark).withColumns({"m_x": F.lit(2.0), "v_x": F.lit(3.0)})
    out = density.control(rows, stats, None, threshold=0.1, extent=100.0, dense=0.01, state=("m_x", "v_x")).collect()
    assert {(r.gid > 5, r.m_x, r.v_x) for r in out} == {(False, 2.0, 3.0), (True, 0.0, 0.0)}
    reset = density.with_reset_opacity(rows, ("m_x",)).filter("gid in (0, 3)").orderBy("gid").collect()
    assert math.isclose(reset[0].opacity, math.log(0.01 / 0.99)) and math.isclose(reset[1].opacity, -9.0) and reset[0].m_x == 0.0 and reset[0].v_x == 3.0
    cloud = spark.createDataFrame([(k, float(k), 0.0, 0.0, 0.5, 1.0, 0.0) for k in range(4)], "gid long, x double, y double, z double, red double, green double, blue double")
    first = density.initial(cloud).orderBy("gid").first()
    assert math.isclose(first.s1, math.log(math.sqrt(14 / 3))) and first.q0 == 1.0 and first.f_dc[0] == 0.0 and len(first.f_rest) == 45
    assert density.initial(cloud.limit(0)).count() == 0


def test_projection_and_centre(spark):
    m = [[F.lit(v) for v in row] for row in [[0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 0.0, 2.0], [-1.0, 0.0, 0.0, 3.0], [0.0, 0.0, 0.0, 1.0]]]
    p = maths.projection(0.01, 100.0, F.lit(1.0), F.lit(1.0))
    row = spark.range(1).select(*maths.camera_centre(m), *(c for r in maths.full_projection(m, p) for c in r)).first()
    assert tuple(row)[:3] == (3.0, -2.0, -1.0)
    k, f = 1 / math.tan(0.5), 100 / 99.99
    want = np.array([[k, 0, 0, 0], [0, k, 0, 0], [0, 0, f, -0.01 * f], [0, 0, 1, 0]]) @ [[0, 0, 1, 1], [0, 1, 0, 2], [-1, 0, 0, 3], [0, 0, 0, 1]]
    assert np.allclose(np.array(row[3:]).reshape(4, 4), want.T)


def test_sinks_and_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(k, *(float(k * 100 + i) for i in range(62))) for k in range(3)], ", ".join(["gid long", *(f"{c} double" for c in structure.SPLAT_COLUMNS)]))
    files.write_splats(rows, str(tmp_path / "m.ply"))
    got = files.read_splats(spark, str(tmp_path / "m.ply")).filter("gid = 1").first()
    assert got.f_rest == [109.0 + i for i in range(45)] and got.rot == [158.0, 159.0, 160.0, 161.0] and got.opacity == 154.0
    files.write_ply(rows.select("gid", "f_rest_0"), {"f_rest_0": "float"}, str(tmp_path / "bad.ply"))
    with pytest.raises(ValueError, match="whole degree"):
        files.read_splats(spark, str(tmp_path / "bad.ply"))
    for k in (10, 200):
        files.write_checkpoint(rows.limit(k // 10), str(tmp_path / "c"), k, {"step": k})
    back, settings = files.read_checkpoint(spark, str(tmp_path / "c"))
    assert settings == {"step": 200} and back.count() == 3
    assert files.read_checkpoint(spark, str(tmp_path / "c"), 10)[1] == {"step": 10}
    for k in (1, 2):
        files.append_scalars(spark.createDataFrame([("r", k, "loss", 0.5)], "run string, iteration int, tag string, value double"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    png = files.png_bytes(np.zeros((2, 2, 3), np.uint8))
    images = spark.createDataFrame([(f"test/ours_7/renders/{k:05d}.png", bytearray(png)) for k in range(5)], "path string, png binary")
    assert {r.bytes for r in files.write_images(images, str(tmp_path / "out")).collect()} == {len(png)}
    assert (tmp_path / "out/test/ours_7/renders/00004.png").read_bytes() == png
    assert len(list((tmp_path / "out/test/ours_7/renders").glob("*.png"))) == 5


def test_capture_exposure_and_validation(spark):
    poses = spark.createDataFrame([("s", 30, 0, 7), ("s", 60, 1, 8)], "scene string, t long, id long, pose int")
    frames = spark.createDataFrame([("s", t, k) for k, t in enumerate([10, 30, 45, 70])], "scene string, t long, id long")
    got = views.capture_frames(frames, poses, ["scene"], "t", "id", ["pose"]).orderBy("t").collect()
    assert [(r.t, r.pose, r.image_id, r.name) for r in got] == [(30, 7, 1, "00001.png"), (45, 7, 2, "00002.png"), (70, 8, 3, "00003.png")]
    names = spark.createDataFrame([("a",), ("b",)], "image_name string")
    known = spark.createDataFrame([("b", [[2.0] * 4] * 3)], "image_name string, m array<array<double>>")
    m = {r.image_name: r.m for r in views.with_exposure(names, known).collect()}
    assert m["a"] == np.eye(4)[:3].tolist() and m["b"] == [[2.0] * 4] * 3
    train = spark.createDataFrame([(f"n{k:02d}",) for k in range(12)], "name string")
    shown = views.validation_views(train, train.limit(1), ["name"]).collect()
    assert sorted(r.name for r in shown if r.split == "train") == ["n01", "n03", "n05", "n08", "n10"]
    assert spark.sql("select timestamp'2024-03-05 06:07:08' t").select(text.log_label(F.col("t"))).first()[0] == "05/03 06:07:08"
