"""Structured Streaming over append-only logs and call records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ship
from ..storage import written


def tail(spark: SparkSession, path: str, schema: str = S.RETRIEVAL_LOG, per_trigger: int = 1000) -> DataFrame:
    """Rows of JSON-lines files as they are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def per_minute(df: DataFrame, ts: str = "ts", key: str = "user_id", width: str = "1 minute", limit: int = 60, late: str | None = None) -> DataFrame:
    """Calls per key and minute, and whether they are above the limit."""
    d = df.withWatermark(ts, late) if late else df
    g = d.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("limited"))


def windowed(df: DataFrame, ts: str, width: str, slide: str | None, key: str, value: str, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late else df
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return d.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    d = df.withWatermark(ts, late) if late else df
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), key, "n")


def session_memory(turns: DataFrame, most: int = 5, key: str = "conv_id") -> DataFrame:
    """turns (stream): conv_id, turn, role, text. Keeps the last turns of each
    session as state and emits the session's context after every batch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = [(int(r.split("\x1f")[0]), r) for r in held]
        for f in frames:
            rows += [(int(t), f"{t}\x1f{r}: {x}") for t, r, x in zip(f["turn"], f["role"], f["text"], strict=True)]
        rows = sorted(rows)[-most:]
        state.update(([r for _, r in rows],))
        yield pd.DataFrame({key: [k[0]], "context": ["\n".join(r.split("\x1f", 1)[1] for _, r in rows)]})

    ship(turns.sparkSession)
    kind = turns.schema[key].dataType.simpleString()
    return turns.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, context string", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def breaker_step(state: tuple[int, float], t: float, ok: bool, failures: int, recovery_s: float) -> tuple[str, tuple[int, float]]:
    """State before a call, and what the breaker goes on with: failures in a
    row, and when it opened (negative: it is closed)."""
    fails, opened = state
    if opened >= 0 and t - opened < recovery_s:
        return "open", state
    name = "half_open" if opened >= 0 else "closed"
    if ok:
        return name, (0, -1.0)
    return name, (fails + 1, t if opened >= 0 or fails + 1 >= failures else -1.0)


CLOSED = (0, -1.0)


def circuit_breaker(calls: DataFrame, failures: int = 3, recovery_s: float = 30.0) -> DataFrame:
    """calls: provider, ts (timestamp), ok. State before each call: closed,
    open (the call is refused) or half_open (a trial).

    The log is cut into segments by range of (provider, ts). A segment's
    summary is the state it ends in from the state it is entered with; first
    every segment is entered closed, then those whose predecessor ends in
    another state are run again, until none changes. The automaton forgets its
    past at every success, so few rounds change anything; after round r the
    first r segments are right whatever the data. No provider's log is in one
    task or row, and the driver holds one state a segment.
    """
    rows = calls.select(F.col("provider").cast("string").alias("provider"), F.col("ts").cast("timestamp").cast("double").alias("t"), "ok").where("provider is not null and t is not null and ok is not null")

    def numbered(batches):
        part = TaskContext.get().partitionId()
        for b in batches:
            yield b.append_column("part", pa.array([part] * len(b), pa.int32()))

    ship(calls.sparkSession)
    order = ["provider", "t", "ok"]
    log = written(rows.repartitionByRange(*order).mapInArrow(numbered, "provider string, t double, ok boolean, part int"), "breaker-log")

    def run(entered: dict[int, tuple[int, float]], emit: bool) -> DataFrame:
        def go(batches):
            part = at = first = None
            state = CLOSED
            for b in batches:
                ends, states = [], []
                for p, provider, t, ok in zip(*(b.column(c).to_pylist() for c in ("part", *order)), strict=True):
                    if p != part:
                        if part is not None:
                            ends.append((part, first, at, *state))
                        part, at, first, state = p, provider, provider, entered.get(p, CLOSED)
                    elif provider != at:
                        at, state = provider, CLOSED
                    name, state = breaker_step(state, t, ok, failures, recovery_s)
                    states.append(name)
                if emit:
                    yield b.append_column("state", pa.array(states, pa.string()))
                elif ends:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ends, strict=True)], names=["part", "first", "last", "fails", "opened"])
            if part is not None and not emit:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, first, at, *state)], names=["part", "first", "last", "fails", "opened"])

        some = log if emit or not entered else log.where(F.col("part").isin(list(entered)))
        dealt = some.repartition("part").sortWithinPartitions("part", *order)
        return dealt.mapInArrow(go, "provider string, t double, ok boolean, part int, state string" if emit else "part long, first string, last string, fails long, opened double")

    entered: dict[int, tuple[int, float]] = {}
    ends = {r["part"]: r for r in run({}, False).collect()}  # one row a segment
    while True:
        changed, before = {}, None
        for p in sorted(ends):
            r = ends[p]
            state = (before["fails"], before["opened"]) if before is not None and before["last"] == r["first"] else CLOSED
            if state != entered.get(p, CLOSED):
                changed[p] = state
            before = r
        if not changed:
            break
        entered |= changed
        ends |= {r["part"]: r for r in run(changed, False).collect()}
    return run(entered, True).select("provider", F.col("t").cast("timestamp").alias("ts"), "ok", "state")


def breaker_stream(calls: DataFrame, failures: int = 3, recovery_s: float = 30.0) -> DataFrame:
    """circuit_breaker over a stream: the state of a provider is kept between
    batches; calls of a batch go by time, those of earlier times that come
    later are taken as they come."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = tuple(state.get) if state.exists else CLOSED, pd.concat(list(frames)).sort_values(["t", "ok"])
        names = []
        for t, ok in zip(held["t"], held["ok"], strict=True):
            name, now = breaker_step(now, float(t), bool(ok), failures, recovery_s)
            names.append(name)
        state.update((int(now[0]), float(now[1])))
        yield pd.DataFrame({"provider": k[0], "t": held["t"].to_numpy(), "ok": held["ok"].to_numpy(), "state": names})

    ship(calls.sparkSession)
    rows = calls.select(F.col("provider").cast("string").alias("provider"), F.col("ts").cast("timestamp").cast("double").alias("t"), "ok")
    out = rows.groupBy("provider").applyInPandasWithState(run, "provider string, t double, ok boolean, state string", "fails int, opened double", "append", GroupStateTimeout.NoTimeout)
    return out.select("provider", F.col("t").cast("timestamp").alias("ts"), "ok", "state")


def backoff(key: str, attempt: int, base_s: float, most_s: float) -> float:
    """Seconds before the next attempt: doubled each time, plus up to a second
    of jitter from a hash of key and attempt, at most most_s."""
    jitter = zlib.crc32(f"{key}:{attempt}".encode()) / 2**32
    return min(most_s, base_s * 2 ** (attempt - 1) + jitter)


def retries(outcomes: DataFrame, most: int = 3, base_s: float = 1.0, most_s: float = 30.0) -> DataFrame:
    """What to do about calls, as a stream of request_id, attempt, action.

    outcomes (stream): request_id, ok, transient. A success is "done"; a
    failure that is not transient, or the last attempt that is allowed, is
    "dead" (the dead-letter rows); after any other a timer of the request
    waits for its backoff and then says "retry". A request is settled once:
    outcomes replayed after that change nothing.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def row(k, attempt: int, action: str) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [k[0]], "attempt": [attempt], "action": [action]})

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, settled = tuple(state.get) if state.exists else (0, False)
        if state.hasTimedOut:
            yield row(k, attempt + 1, "retry")
            state.update((attempt, settled))
            return
        for f in frames:
            for ok, transient in zip(f["ok"], f["transient"], strict=True):
                if settled:
                    continue
                attempt += 1
                settled = bool(ok) or not transient or attempt >= most
                if settled:
                    yield row(k, attempt, "done" if ok else "dead")
        state.update((attempt, settled))
        if not settled:
            state.setTimeoutDuration(max(1, int(1000 * backoff(str(k[0]), attempt, base_s, most_s))))

    ship(outcomes.sparkSession)
    kind = outcomes.schema["request_id"].dataType.simpleString()
    return outcomes.groupBy("request_id").applyInPandasWithState(run, f"request_id {kind}, attempt int, action string", "attempt int, settled boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_sink(table, keys: list[str]):
    """foreachBatch function that upserts into a writers.Table: batches that
    are replayed after a failure change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            table.upsert(batch, keys)

    return write
