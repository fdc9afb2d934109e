"""The viewers' control loop: on a stream with a restart, on a table, and by a plain loop."""

import datetime
import json
import random

from pointloom.streaming import control

SCHEMA = "client string, t timestamp, id long, width int, height int, train boolean, keep_alive boolean"
START = datetime.datetime(2024, 1, 1)


def requests_of(rng, n):
    rows, now = [], {}
    for k in range(n):
        client = rng.choice(["a", "b", "c"])
        now[client] = now.get(client, START) + datetime.timedelta(seconds=rng.choice([1, 5, 20, 61, 200]))
        rows.append((client, now[client], k, rng.choice([0, 8, 8]), rng.choice([8, 8, None]), rng.choice([True, True, False, None]), rng.choice([True, False])))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def plain(rows, iterations, timeout=60):
    """The loop itself, client by client."""
    out, state = [], {}
    for client, t, _, width, height, train, keep in sorted(rows, key=lambda r: (r[1], r[2])):
        n, trained, done, last = state.get(client, (0, 0, 0, None))
        if last is not None and (t - last).total_seconds() > timeout:
            out.append((client, last + datetime.timedelta(seconds=timeout), "lost", n, False, False, done, False))
        go = bool(train) and (trained < iterations or not keep)
        state[client] = (n + 1, trained + bool(train), done + go, t)
        out.append((client, t, "request", n + 1, bool(width and height), go, done + go, not go))
    return sorted(out, key=str), state


def test_answers_of_a_table(spark):
    rows = requests_of(random.Random(1), 120)
    got = control.answers(spark.createDataFrame(rows, SCHEMA).repartition(3), 7).select(control.COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 7)[0]
    assert {r.waiting for r in got} == {True, False} and max(r.iteration for r in got) > 7


def test_answers_of_a_stream_with_a_restart(spark, tmp_path):
    rows = requests_of(random.Random(2), 60)
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def feed(name, part):
        lines = [json.dumps(dict(zip(("client", "t", "id", "width", "height", "train", "keep_alive"), (r[0], r[1].isoformat(), *r[2:]), strict=True))) for r in part]
        (tmp_path / "in" / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        out = control.stream_answers(stream, 5)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    try:
        for k, part in enumerate((rows[:25], rows[25:], [("z", START + datetime.timedelta(days=1), 999, 8, 8, True, False)])):
            feed(f"{k}.json", part)
            run()  # a new query each time: state and timers come from the checkpoint
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).select(control.COLUMNS)
    want, state = plain(rows, 5)
    ends = [(c, s[3] + datetime.timedelta(seconds=60), "lost", s[0], False, False, s[2], False) for c, s in state.items()]
    assert sorted((tuple(r) for r in got.filter("client <> 'z'").collect()), key=str) == sorted(want + ends, key=str)
    assert got.filter("client = 'z'").select("n", "iteration").first() == (1, 1)
    batch = control.answers(spark.createDataFrame(rows, SCHEMA), 5).select(control.COLUMNS)
    assert batch.exceptAll(got).count() == 0
