"""State machines for each key, over tables and over streams, from one definition.

A machine holds a few named states, steps with every row of its key, and may name a time at
which it acts without one.  Over a table a key's rows are dealt to one task, sorted, and
stream through it.  Over a stream each named state is a value in the state store, and times
are event-time timers: before a row is taken, all that was due earlier happens, and timers
do the same for keys that stay silent, so that batches cut a stream anywhere.

A table ends at ``until_ms``; a stream where its watermark stands.  Rows of one micro-batch
and key are sorted in memory, as Arrow columns if the machine isn't timed, so bound a batch
by the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, fields
from functools import cache
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor

Values = dict[str, Any]
#: How late a row of a stream may come, and so how far its clocks stay behind.
LATENESS = "2 seconds"
LATENESS_MS = 2000
_KINDS = {"float": "double", "int": "long", "bool": "boolean", "str": "string", "list": "array<double>"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


class Machine:
    """``STATES``: a dataclass for each named state; ``OUT``: the columns of what it says, the key first."""

    STATES: dict[str, type] = {}
    OUT = ""
    #: Whether it names times.  One that doesn't takes rows of any age.
    TIMED = False

    def __init__(self) -> None:
        for name, kind in self.STATES.items():
            setattr(self, name, kind())

    def pack(self) -> dict[str, tuple]:
        """Its states as the state store keeps them."""
        return {name: astuple(getattr(self, name)) for name in self.STATES}

    def unpack(self, held: dict[str, tuple]) -> None:
        for name, values in held.items():
            setattr(self, name, self.STATES[name](*(list(v) if isinstance(v, (list, tuple)) else v for v in values)))

    def begin(self, row: Values) -> None:
        """Take over what was known of the key before its first row."""

    def step(self, row: Values) -> Iterator[Values]:
        """What a row makes it say."""
        return iter(())

    def due(self) -> int | None:
        """When it acts next if no row comes."""
        return None

    def tick(self, at_ms: int) -> Iterator[Values]:
        """What it says at a time that it named."""
        return iter(())

    def until(self, end_ms: int) -> Iterator[Values]:
        """All that is due up to and including ``end_ms``."""
        while (at := self.due()) is not None and at <= end_ms:
            yield from self.tick(at)

    def take(self, row: Values) -> Iterator[Values]:
        yield from self.until(row["ts_ms"] - 1)
        yield from self.step(row)


@cache
def state_schema(kind: type) -> str:
    return ", ".join(f"{f.name} {_KINDS[str(f.type).split(' ')[0]]}" for f in fields(kind))


def columns_of(schema: str) -> dict[str, str]:
    return dict(x.strip().split(" ") for x in schema.split(","))


def arrow_schema(machine: type[Machine]) -> pa.Schema:
    return pa.schema([(n, _ARROW[k]) for n, k in columns_of(machine.OUT).items()])


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by a key to as many tasks as a shuffle has: small rows may be long work, so few bytes are no reason for few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def fold(rows: DataFrame, machine: type[Machine], until_ms: int | None = None, initial: DataFrame | None = None, key: str = "rig") -> DataFrame:
    """What ``machine`` says over a table of ``key, ts_ms, ord, ...``; ``initial``: a row for each key to begin from."""
    schema = arrow_schema(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, m = None, None
        for batch in batches:
            said: list[Values] = []
            for row in batch.to_pylist():
                if m is None or row[key] != now:
                    if m is not None and until_ms is not None:
                        said += ({key: now, **x} for x in m.until(until_ms))
                    now, m = row[key], machine()
                if row.pop("_initial"):
                    m.begin(row)
                else:
                    said += ({key: now, **x} for x in m.take(row))
            yield pa.RecordBatch.from_pylist(said, schema)
        if m is not None and until_ms is not None:
            yield pa.RecordBatch.from_pylist([{key: now, **x} for x in m.until(until_ms)], schema)

    rows = rows.withColumn("_initial", F.lit(False))
    if initial is not None:
        rows = rows.unionByName(initial.withColumn("_initial", F.lit(True)), allowMissingColumns=True)
    return dealt(rows, key).sortWithinPartitions(key, F.desc("_initial"), "ts_ms", "ord").mapInArrow(run, machine.OUT)


#: Rows that a task of a stream packs at once, and that a machine takes or says between two packs.
PACK_ROWS, SLICE_ROWS = 50_000, 10_000


def packs_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[Any, bytes]]:
    """Rows by key: each key and its rows as an Arrow stream."""
    held, n = [], 0
    batches = iter(batches)
    while (batch := next(batches, None)) is not None or held:
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if batch is None or n >= PACK_ROWS:
            table = pa.Table.from_batches(held).sort_by(key).combine_chunks()
            held, n, begin = [], 0, 0
            runs = pc.run_end_encode(table[key].combine_chunks()) if table.num_rows else None
            for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs is not None else ():
                yield value, packed(table.slice(begin, end - begin))
                begin = end


def packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def plain(column: pa.Array) -> list:
    """A column's values; numbers, structs and lists aren't taken value by value."""
    kind = column.type
    if pa.types.is_list(kind):
        flat, values, at = plain(column.flatten()), [], 0
        for n in plain(pc.list_value_length(column)):
            values.append(None if n is None else flat[at : at + n])
            at += n or 0
        return values
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        if not column.null_count:
            return column.to_numpy(zero_copy_only=False).tolist()
        return [None if gone else x for x, gone in zip(plain(column.fill_null(False if pa.types.is_boolean(kind) else 0)), plain(column.is_null()))]
    if pa.types.is_struct(kind) and not column.null_count:
        names = [f.name for f in kind]
        return [dict(zip(names, x)) for x in zip(*(plain(c) for c in column.flatten()))]
    return column.to_pylist()


def in_order(packs: Iterable[bytes]) -> Iterator[Values]:
    """The rows of all packs of a key, by time."""
    table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in packs]).combine_chunks()
    order = pc.sort_indices(table.select(["ts_ms", "ord"]), [("ts_ms", "ascending"), ("ord", "ascending")])
    names = table.column_names
    for at in range(0, len(order), SLICE_ROWS):
        rows = table.take(order[at : at + SLICE_ROWS])
        for values in zip(*(plain(c.combine_chunks()) for c in rows.columns)):
            yield dict(zip(names, values))


class Live(StatefulProcessor):
    """A machine over a stream, row by row."""

    def __init__(self, machine: type[Machine], ttl_ms: int | None = None) -> None:
        self.machine, self.names, self.ttl_ms = machine, list(columns_of(machine.OUT)), ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = {name: handle.getValueState(name, state_schema(kind), self.ttl_ms) for name, kind in self.machine.STATES.items()}

    def _load(self) -> Machine:
        m = self.machine()
        m.unpack({name: tuple(v.get()) for name, v in self.held.items() if v.exists()})
        return m

    def _save(self, m: Machine) -> None:
        for name, values in m.pack().items():
            self.held[name].update(values)
        if not m.TIMED:
            return
        due = m.due()
        before = list(self.handle.listTimers())
        for at in before:
            if at != due:
                self.handle.deleteTimer(at)
        if due is not None and due not in before:
            self.handle.registerTimer(due)

    def _said(self, key: tuple, values: Values) -> Row:
        return Row(*self.names)(key[0], *(values.get(n) for n in self.names[1:]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        m = self._load()
        for row in sorted(rows, key=lambda r: (r["ts_ms"], r["ord"])):
            for x in m.take(row.asDict()):
                yield self._said(key, x)
        self._save(m)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        m = self._load()
        for x in m.until(timerValues.getCurrentWatermarkInMs()):
            yield self._said(key, x)
        self._save(m)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        m = self._load()
        m.begin(initialState.asDict())
        self._save(m)

    def close(self) -> None:
        pass


class LivePacked(Live):
    """The same over rows that come packed by key (``_rows``) and go packed: a row in Spark's own form costs more than its step."""

    def init(self, handle) -> None:
        super().init(handle)
        self.schema = arrow_schema(self.machine)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        m = self._load()
        said = ({self.names[0]: key[0], **x} for row in in_order(r["_rows"] for r in rows) for x in m.take(row))
        while some := list(islice(said, SLICE_ROWS)):
            yield Row("_rows")(packed(pa.RecordBatch.from_pylist(some, self.schema)))
        self._save(m)


#: The state store that keeps named states and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live(rows: DataFrame, machine: type[Machine], initial: DataFrame | None = None, key: str = "rig") -> DataFrame:
    """The same over a stream; the session needs ``PROVIDER``.  ``initial`` is handed to the state store once.

    Rows of a machine that isn't timed travel packed by key; those of a timed one go singly, since its watermark
    tells of each whether it is late.
    """
    first = None if initial is None else initial.groupBy(key)
    if machine.TIMED:
        rows = rows.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", LATENESS)
        return rows.groupBy(key).transformWithState(Live(machine), machine.OUT, "Append", "EventTime", first)
    kind = rows.schema[key].dataType.simpleString()
    arrow_key = to_arrow_type(rows.schema[key].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, some in packs_of(batches, key):
            yield pa.RecordBatch.from_arrays([pa.array([value], arrow_key), pa.array([some], pa.binary())], [key, "_rows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in batch["_rows"]:
                yield from pa.ipc.open_stream(some.as_buffer())

    told = rows.mapInArrow(pack, f"`{key}` {kind}, _rows binary").groupBy(key).transformWithState(LivePacked(machine), "_rows binary", "Append", "None", first)
    return told.mapInArrow(unpack, machine.OUT)
