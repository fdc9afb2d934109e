"""Binary models in pieces and text models across splits, against plain parsers of whole files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from pointloom import session
from pointloom.sources import model_format, sparse


def plain_binary(data, kind):
    """All records of a file, one after the other."""
    at, out = 8, []
    for _ in range(struct.unpack_from("<Q", data)[0]):
        if kind == "images":
            ident, *pose, camera = struct.unpack_from("<i7di", data, at)
            end = data.index(b"\0", at + 64)
            name, at = data[at + 64 : end].decode(), end + 1
            n = struct.unpack_from("<Q", data, at)[0]
            items = [struct.unpack_from("<ddq", data, at + 8 + 24 * k) for k in range(n)]
            at += 8 + 24 * n
            out.append((ident, pose[:4], pose[4:], camera, name, items))
        else:
            head = struct.unpack_from("<QdddBBBd", data, at)
            n = struct.unpack_from("<Q", data, at + 43)[0]
            out.append((*head, [struct.unpack_from("<ii", data, at + 51 + 8 * k) for k in range(n)]))
            at += 51 + 8 * n
    assert at == len(data)
    return out


def plain(row):
    return tuple([tuple(x) if not isinstance(x, float) else x for x in v] if isinstance(v, list) else v for v in row)


def key(rows):
    return sorted(rows, key=lambda r: r[0])


def points_file(rng, n, trap=False):
    """trap: tracks whose bytes look like records of their own."""
    out = [struct.pack("<Q", n)]
    fake = struct.pack("<QdddBBBdQ", 5, 1.0, 2.0, 3.0, 1, 2, 3, 0.5, 0) * 12
    for k in range(n):
        length = rng.choice([0, 1, 2, 7, 300]) if not trap else len(fake + b"12345678") // 8
        track = fake.ljust(8 * length, b"\1")[: 8 * length] if trap else b"".join(struct.pack("<ii", rng.randrange(99), j) for j in range(length))
        out.append(struct.pack("<QdddBBBdQ", 1000 + k, k * 0.5, -1.5, rng.random(), k % 256, 7, 255, 0.25, length) + track)
    return b"".join(out)


def images_file(rng, n):
    out = [struct.pack("<Q", n)]
    for k in range(n):
        seen = b"".join(struct.pack("<ddq", rng.random(), j, rng.choice([-1, j])) for j in range(rng.choice([0, 1, 40])))
        out.append(struct.pack("<i7di", k, 0.6, 0.0, 0.8, 0.0, 1.0, -2.0, float(k), 3) + f"é/v{k}.png".encode() + b"\0" + struct.pack("<Q", len(seen) // 24) + seen)
    return b"".join(out)


@pytest.mark.parametrize(("kind", "piece"), [("points", 1 << 20), ("points", 700), ("points", 61), ("trap", 500), ("images", 900), ("images", 128)])
def test_pieces_equal_a_plain_reader(spark, tmp_path, kind, piece):
    rng = random.Random(piece)
    data = images_file(rng, 60) if kind == "images" else points_file(rng, 60, kind == "trap")
    kind = "images" if kind == "images" else "points"
    (tmp_path / "m.bin").write_bytes(data)
    pieces = model_format.index_files(spark, str(tmp_path / "m.bin"), kind, piece)
    assert sum(p["n"] for p in pieces) == 60 and (len(pieces) > 5) == (piece < 1000)
    rows = model_format.read_pieces(spark, str(tmp_path / "m.bin"), kind, piece_bytes=piece)
    assert key(plain(r) for r in rows.collect()) == key(plain_binary(data, kind))
    assert rows.rdd.getNumPartitions() == len([p for p in pieces if p["n"]])


def test_pruned_columns_and_conditions(spark, tmp_path, monkeypatch):
    rng = random.Random(0)
    data = points_file(rng, 200)
    (tmp_path / "points3D.bin").write_bytes(data)
    want = plain_binary(data, "points")
    some = model_format.read_pieces(spark, str(tmp_path / "points3D.bin"), "points", ["x", "point3d_id"], 2000)
    assert some.columns == ["x", "point3d_id"]
    assert sorted(tuple(r) for r in some.collect()) == sorted((r[1], r[0]) for r in want)
    rows = model_format.read_pieces(spark, str(tmp_path / "points3D.bin"), "points", piece_bytes=2000)
    where = [("point3d_id", ">=", 1190), ("g", "=", 7), ("r", "in", [192, 193])]
    few = model_format.read_pieces(spark, str(tmp_path / "points3D.bin"), "points", piece_bytes=2000, where=where)
    assert few.rdd.getNumPartitions() < rows.rdd.getNumPartitions() / 3
    assert key(plain(r) for r in few.collect()) == [r for r in want if r[0] >= 1190 and r[4] in (192, 193)]
    # a frame can be filtered and used again whole
    assert few.filter("r = 192").count() == 1 and few.count() == 2 and rows.filter("point3d_id = 5").count() == 0 and rows.count() == 200
    with pytest.raises(Exception, match="no condition"):
        model_format.read_pieces(spark, str(tmp_path / "points3D.bin"), "points", where=[("track", "=", 1)]).count()
    # lists are not touched when the schema has none
    reader = model_format.ModelReader({"kind": "points", "path": f"file://{tmp_path}/points3D.bin"}, some.schema)
    monkeypatch.setattr(reader, "_lists", None)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 200


def test_format_without_an_index(spark, tmp_path):
    data = points_file(random.Random(4), 90)
    (tmp_path / "p.bin").write_bytes(data)
    model_format.register(spark)
    rows = spark.read.format("sparse_model").option("kind", "points").option("piece_bytes", 1000).load(f"file://{tmp_path}/p.bin")
    assert rows.rdd.getNumPartitions() > 5
    assert key(plain(r) for r in rows.collect()) == key(plain_binary(data, "points"))


def test_faulty_models_are_refused(spark, tmp_path):
    data = points_file(random.Random(1), 30)
    (tmp_path / "cut.bin").write_bytes(data[:-3])
    (tmp_path / "more.bin").write_bytes(struct.pack("<Q", 31) + data[8:])
    (tmp_path / "none.bin").write_bytes(struct.pack("<Q", 0))
    for name in ("cut", "more"):
        for piece in (100, 1 << 20):
            with pytest.raises(ValueError, match="cut short|announced"):
                model_format.index_files(spark, str(tmp_path / f"{name}.bin"), "points", piece)
    assert sparse.read_points_binary(spark, str(tmp_path / "none.bin")).count() == 0


def test_many_files(spark, tmp_path):
    want = []
    for k in range(3):
        data = images_file(random.Random(k), 20 + k)
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "images.bin").write_bytes(data)
        want += plain_binary(data, "images")
    rows = model_format.read_pieces(spark, f"{tmp_path}/*/images.bin", "images", piece_bytes=700)
    assert sorted(map(str, (plain(r) for r in rows.collect()))) == sorted(map(str, want))


# ---- text


def plain_text(text):
    rows, out = iter(text.split("\n")), []
    for line in rows:
        f = line.split()
        if f and not f[0].startswith("#"):
            seen = next(rows, "").split()
            out.append((int(f[0]), f[9], [(float(seen[i]), float(seen[i + 1]), int(seen[i + 2])) for i in range(0, len(seen) - 2, 3)]))
    return sorted(out)


def image_text(rng, n):
    lines = ["# head", "#"]
    for k in range(n):
        lines += rng.choice([[], [""], ["  # a comment 1 2"], ["", "", "#x"]])
        lines += [f"{k} 1 0 0 0 0.5 -1 2 3 v{k}.png{rng.choice(['', ' ', chr(9)])}", rng.choice(["", "  ", "1.5 2 -1", "1.5 2 -1 3 4 5", "# 4 5"][: 4 if k % 5 else 3])]
    return "\n".join(lines) + rng.choice(["", "\n", "\n\n"])


def test_text_images_cut_anywhere(spark, tmp_path):
    """Splits of two bytes and more, so that every line end is at a split's end in some of them."""
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rng = random.Random(2)
    try:
        for trial, size in enumerate([2, 7, 29, 10_000]):
            text = image_text(rng, 5)
            (tmp_path / f"i{trial}.txt").write_text(text)
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sparse.read_images_text(spark, str(tmp_path / f"i{trial}.txt")).select("image_id", "name", "points2d").collect()
            assert sorted(plain(r) for r in got) == plain_text(text), size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        got = sparse.read_images_text(spark, f"{tmp_path}/i*.txt").select("image_id", "name", "points2d").collect()
        assert sorted(plain(r) for r in got) == sorted(r for k in range(4) for r in plain_text((tmp_path / f"i{k}.txt").read_text()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_a_long_second_line_spans_splits(spark, tmp_path):
    seen = " ".join(f"{k}.5 2.0 {k}" for k in range(3000))
    (tmp_path / "i.txt").write_text(f"#\n1 1 0 0 0 0 0 0 3 a.png\n{seen}\n2 1 0 0 0 0 0 0 3 b.png\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = sparse.read_images_text(spark, str(tmp_path / "i.txt")).select("name", F.size("points2d").alias("n"), F.try_element_at("points2d", F.lit(-1))["point3d_id"].alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.name, r.n) for r in got) == [("a.png", 3000), ("b.png", 0)] and 2999 in {r.p for r in got}


def test_places_as_pyarrow_takes_them():
    assert session.arrow_uri("s3a://bucket/a/b") == session.arrow_uri("s3n://bucket/a/b") == "s3://bucket/a/b"
    assert session.arrow_uri("file:/a/b") == session.arrow_uri("file:///a/b") == "file:///a/b"
    assert session.arrow_uri("hdfs://name:8020/a") == "hdfs://name:8020/a"
