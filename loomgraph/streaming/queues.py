"""Bounded sample queues as keyed streaming state.

A queue holds the newest samples of a key. Samples and requests to take some arrive in one stream; the samples of a
queue live in list state and its counters in value state, so a batch touches the keys that it names and nothing else,
and a restart goes on where the checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COUNTERS = "produced bigint, consumed bigint, dropped bigint"
ROOM = 64  # samples beyond four times the size of a queue before the oldest go
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class BoundedQueue(StatefulProcessor):
    """Samples of one key, oldest first, at most `size` of them."""

    def __init__(self, key: str, sample: list[str], sample_schema: str, order: list[str], size: int):
        self.key, self.sample, self.schema, self.order, self.size = key, sample, sample_schema, order, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", self.schema)
        self.counters = handle.getValueState("counters", COUNTERS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        produced, consumed, dropped = self.counters.get() if self.counters.exists() else (0, 0, 0)
        held = list(self.queue.get()) if self.queue.exists() else []
        place = [self.sample.index(c) for c in self.order]

        def age(sample: tuple) -> tuple:
            return tuple((sample[i] is not None, sample[i]) for i in place)  # a null is oldest

        wanted = lost = 0
        for row in rows:
            if row["take"] is None:
                held.append(tuple(row[c] for c in self.sample))
                produced += 1
                if len(held) > 4 * self.size + ROOM:
                    held.sort(key=age)
                    lost, held = lost + len(held) - self.size, held[len(held) - self.size :]
            else:
                wanted += row["take"]
        held.sort(key=age)
        over = max(0, len(held) - self.size)
        lost, held = lost + over, held[over:]
        taken, left = held[:wanted], held[wanted:]
        consumed, dropped = consumed + len(taken), dropped + lost
        self.counters.update((produced, consumed, dropped))
        if left:
            self.queue.put([tuple(s) for s in left])
        else:
            self.queue.clear()
        fields = [self.key, "event", *self.sample, "queue_size", "produced", "consumed", "dropped"]
        for sample in taken:
            yield Row(*fields)(key[0], "taken", *sample, None, None, None, None)
        yield Row(*fields)(key[0], "state", *([None] * len(self.sample)), len(left), produced, consumed, dropped)

    def close(self) -> None:
        pass


def bounded_queues(stream: DataFrame, key: str, sample: list[str], order: list[str], size: int) -> DataFrame:
    """Updates of the queues of `stream(key, *sample, take)`.

    A row with a null `take` puts its sample, one with a number asks for so many. In a batch a queue takes in the
    samples, drops its oldest by `order` beyond `size`, and hands out its oldest. Rows of `event` 'taken' are the samples
    handed out; one row of `event` 'state' per touched key has `queue_size` and the counters so far. Requests beyond the
    queue are not kept. A null key is a queue too. A task holds a few times `size` samples of a key.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    # timestamps live in the state as microseconds, which have no time zone
    times = [c for c in sample if fields[c] == "timestamp"]
    stream = stream.withColumns({c: F.unix_micros(c) for c in times})
    fields |= {c: "bigint" for c in times}
    schema = ", ".join(f"{c} {fields[c]}" for c in sample)
    out = f"{key} {fields[key]}, event string, {schema}, queue_size bigint, {COUNTERS}"
    queue = BoundedQueue(key, sample, schema, order, size)
    updates = stream.select(key, *sample, "take").groupBy(key).transformWithState(
        statefulProcessor=queue, outputStructType=out, outputMode="Update", timeMode="None"
    )
    return updates.withColumns({c: F.timestamp_micros(c) for c in times})


_users: list[str | None] = []  # the setting before each of the queries that run now
_lock = Lock()


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that list state needs, while a query starts and runs; the last one out restores the setting."""
    with _lock:
        _users.append(_users[0] if _users else spark.conf.get(PROVIDER, None))
        spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        with _lock:
            before = _users.pop()
            if not _users and before is None:
                spark.conf.unset(PROVIDER)
            elif not _users:
                spark.conf.set(PROVIDER, before)


def queue_contents(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """What the queues hold at the end of a checkpoint: the key and the samples, timestamps as microseconds."""
    with keyed_state(spark):
        rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "queue").load()
    return rows.select(F.col(f"key.{key}").alias(key), "list_element.*")
