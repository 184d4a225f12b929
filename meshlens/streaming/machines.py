"""Keyed state machines over rows in order of time, the same for tables and for streams.

A machine sees the rows of one key one by one in order of time and keeps one small state. Over a table, keys are shuffled, rows sorted
by key and time within partitions, and tasks stream through them with the state of one key in memory, however many rows it has. Over a stream,
rows wait in the key's state until the watermark has passed them, so that those that come late but in time are put in order; timers
of event time wake a key for its rows and for its state's own end. Both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

#: Columns that every machine's rows begin with: time in microseconds and the number that orders rows of the same time.
ORDER = ["us", "n"]


class Machine:
    """What to do with the rows of a key; states are lists of numbers and texts, null before the first row."""

    #: Columns of a row beside ``ORDER``, whole numbers all (null ones are 0), and the columns of a result beside the keys.
    fields: list[str] = []
    output: str = ""

    def step(self, state: list | None, row: tuple) -> tuple[list | None, list[tuple]]:
        """The state after ``row`` (us, n, *fields), and what came to an end before or with it."""
        raise NotImplementedError

    def ends(self, state: list) -> int | None:
        """The last microsecond at which a row can still change ``state``; null for no such end."""
        return None

    def close(self, state: list) -> list[tuple]:
        """What comes of ``state`` if nothing follows."""
        raise NotImplementedError


def _schema(rows: DataFrame, keys: list[str], machine: Machine) -> StructType:
    out = StructType([rows.schema[k] for k in keys])
    for f in StructType.fromDDL(machine.output):
        out = out.add(f)
    return out


def _whole(rows: DataFrame, machine: Machine) -> DataFrame:
    """Rows with a time; other columns of the machine are whole numbers, null ones 0."""
    return rows.where("us IS NOT NULL").withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in [*ORDER, *machine.fields]})


def over_table(rows: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """Results of ``machine`` over a table with ``keys``, ``ORDER`` and its fields; states left at the end are closed.

    Rows with a null time are dropped; null keys are a key. A key's rows are one task's work, which needs no more memory for more rows.
    """
    columns = [*keys, *ORDER, *machine.fields]
    ready = _whole(rows, machine).select(*columns)
    ready = ready.repartition(*keys).sortWithinPartitions(*keys, *ORDER)
    schema = _schema(rows, keys, machine)
    width, names = len(keys), schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, at, state = to_arrow_schema(schema), None, None

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), shape.types)], names=names)

        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                key = row[:width]
                if key != at:
                    if state is not None:
                        found += [(*at, *x) for x in machine.close(state)]
                    at, state = key, None
                state, done = machine.step(state, row[width:])
                found += [(*at, *x) for x in done]
            if found:
                yield packed(found)
        if state is not None and (rest := [(*at, *x) for x in machine.close(state)]):
            yield packed(rest)

    return ready.mapInArrow(run, schema)


class _Keyed(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str], fields: list[str]):
        self.machine, self.names, self.fields = machine, names, fields

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{f} long" for f in self.fields))
        self.state = handle.getValueState("state", "body string")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            for row in zip(*[part[f].tolist() for f in self.fields]):
                self.waiting.appendValue(row)
                self.handle.registerTimer(row[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        machine, passed = self.machine, timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] <= passed]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        found = []
        for row in ready:
            state, done = machine.step(state, row)
            found += done
        if ready:
            self.waiting.clear()
            if len(rows) > len(ready):
                self.waiting.put(rows[len(ready) :])
        if state is not None and (end := machine.ends(state)) is not None:
            if end <= passed:
                found += machine.close(state)
                state = None
            else:
                self.handle.registerTimer(end // 1000 + 1)
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        if found:
            yield pd.DataFrame([(*key, *x) for x in found], columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def over_stream(rows: DataFrame, keys: list[str], machine: Machine, ts: str, delay: str) -> DataFrame:
    """The same over a stream with the event time ``ts`` beside those columns; rows within ``delay`` are put in order, later ones dropped.

    Needs the RocksDB state store. A state with an end comes out when the watermark has passed that, any other with the row that ends it.
    """
    columns = [*ORDER, *machine.fields]
    of = StructType([rows.schema[k] for k in keys])
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})  # one text: keys of several columns lose nulls on their way to Python
    ready = _whole(rows, machine).withWatermark(ts, delay).select(key.alias("_key"), ts, *columns)
    schema = StructType.fromDDL(f"_key string, {machine.output}")
    found = ready.groupBy("_key").transformWithStateInPandas(_Keyed(machine, schema.fieldNames(), columns), schema, "Append", "EventTime")
    back = F.from_json("_key", of)
    return found.select(*[back[k].alias(k) for k in keys], *schema.fieldNames()[1:])
