"""The control loop between viewers and a training run, as state by client: on a stream, or on a table at once.

A request with a size asks for an image, one without asks for none. While a client is connected, training waits for it: a
request releases the next iteration if it has ``train`` set and either iterations are left or it does not ask to be kept
alive. A client that is silent for longer than a timeout is lost, and training goes on without it until it asks again.

Each request gives a row: its number, whether an image is due, whether it released an iteration, how many it released so far,
and whether training waits for the client. A loss gives a row as well, at the time when it is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "client {kind}, t timestamp, event string, n long, image boolean, released boolean, iteration long, waiting boolean"
COLUMNS = ["client", "t", "event", "n", "image", "released", "iteration", "waiting"]


def answers(requests: DataFrame, iterations: int, timeout: str = "60 seconds") -> DataFrame:
    """The answers to a table of requests (client, t, id, width, height, train, keep_alive), in the order of t and id.

    Requests with train set are counted up: as long as fewer than ``iterations`` came before, each releases one. Losses that
    no later request follows are left out, since a table has no end of time.
    """
    order = Window.partitionBy("client").orderBy("t", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.sum(F.col("train").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    train = F.coalesce("train", F.lit(False))
    rows = requests.withColumn("train", train).withColumn("keep_alive", F.coalesce("keep_alive", F.lit(False)))
    rows = rows.withColumn("released", F.col("train") & ((before < iterations) | ~F.col("keep_alive")))
    rows = rows.withColumns({"n": F.row_number().over(order).cast("long"), "iteration": F.sum(F.col("released").cast("long")).over(upto), "since": F.lag("t").over(order)})
    size = F.coalesce((F.col("width") != 0) & (F.col("height") != 0), F.lit(False))
    asked = rows.select("client", "t", F.lit("request").alias("event"), "n", size.alias("image"), "released", "iteration", (~F.col("released")).alias("waiting"))
    gone = rows.filter(F.col("t") > F.col("since") + F.expr(f"INTERVAL {timeout}"))
    lost = gone.select("client", (F.col("since") + F.expr(f"INTERVAL {timeout}")).alias("t"), F.lit("lost").alias("event"), (F.col("n") - 1).alias("n"), F.lit(False).alias("image"), F.lit(False).alias("released"), (F.col("iteration") - F.col("released").cast("long")).alias("iteration"), F.lit(False).alias("waiting"))
    return asked.unionByName(lost)


class Control(StatefulProcessor):
    """Per client: number of requests, of those with train set, of released iterations, and the time of the last one."""

    def __init__(self, iterations: int, timeout: str):
        self.iterations, self.timeout = iterations, pd.Timedelta(timeout)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "n long, trained long, released long, last timestamp, here boolean")

    def _known(self) -> list:
        return list(self.session.get()) if self.session.exists() else [0, 0, 0, None, False]

    def _lost(self, client, state: list) -> tuple:
        return client, state[3] + self.timeout.to_pytimedelta(), "lost", state[0], False, False, state[2], False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._known(), []
        batch = pd.concat(list(rows)).sort_values(["t", "id"])
        for t, width, height, train, keep in zip(*(batch[c] for c in ("t", "width", "height", "train", "keep_alive")), strict=True):
            t = t.to_pydatetime()
            if state[4] and t > state[3] + self.timeout:
                out.append(self._lost(key[0], state))
            train, keep = (bool(v) and not pd.isna(v) for v in (train, keep))
            released = train and (state[1] < self.iterations or not keep)
            image = not pd.isna(width) and not pd.isna(height) and width != 0 and height != 0
            state = [state[0] + 1, state[1] + train, state[2] + released, t, True]
            out.append((key[0], t, "request", state[0], image, released, state[2], not released))
        self.session.update(tuple(state))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(int(pd.Timestamp(state[3] + self.timeout).tz_localize("UTC").timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._known()
        if state[4]:
            state[4] = False
            self.session.update(tuple(state))
            yield pd.DataFrame([self._lost(key[0], state)], columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_answers(requests: DataFrame, iterations: int, timeout: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """``answers`` on a stream of requests, whose state outlives restarts; losses come when the watermark passes them.

    Requests that are later than ``late`` are dropped; those of one micro-batch are put in order. Needs the RocksDB state
    store, which this sets where the session has another.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ANSWER.format(kind=dict(requests.dtypes)["client"])
    grouped = requests.select("client", "t", "id", "width", "height", "train", "keep_alive").withWatermark("t", late).groupBy("client")
    return grouped.transformWithStateInPandas(Control(iterations, timeout), schema, "Append", "EventTime")
