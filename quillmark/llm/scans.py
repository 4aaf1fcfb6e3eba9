"""Running states along sorted groups of any length.

Rows are dealt by range of (group, order), so a group may span partitions and
its rows never have to meet in one task. Each task runs over its own rows; the
states that tasks end with are composed over the partitions (one row each), and
only rows of a group that began in an earlier partition are worked out again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import map_arrow, settle


def running(
    df: DataFrame,
    group: str,
    order: list[str | Column],
    none: Any,
    element: Callable[[dict], Any],
    compose: Callable[[Any, Any], Any],
    out: str,
    values: Callable[[dict, Any, Any], tuple],
    name: str = "scan",
) -> DataFrame:
    """df's columns and those of the schema out, whose values come from
    values(row, state before the row, state with it).

    The state of rows is compose(... compose(none, element(row 1)), ...) over
    the rows of the same group so far; compose is associative with none as
    neutral element. States have a bounded size. group is not null.
    """
    cols = df.columns
    full = StructType([*[StructField(f.name, f.dataType) for f in df.schema], *df.sparkSession.createDataFrame([], out).schema.fields])
    extra = "__part int, __state binary, __ends binary"
    held = StructType([*full.fields, *df.sparkSession.createDataFrame([], extra).schema.fields])
    arrow, final = to_arrow_schema(held), to_arrow_schema(full)
    n_out = len(full.fields) - len(cols)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def first(batches):
        part, at, start, state, blank = TaskContext.get().partitionId(), None, None, none, (None,) * len(full.fields)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                g = r[group]
                if start is None:
                    start = at = g
                elif g != at:
                    at, state = g, none
                new = compose(state, element(r))
                rows.append((*[r[c] for c in cols], *values(r, state, new), part, pickle.dumps(state) if g == start else None, None))
                state = new
            if rows:
                yield batch_of(rows, arrow)
        if start is not None:
            yield batch_of([(*blank, part, None, pickle.dumps((start, at, state)))], arrow)

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = settle(map_arrow(dealt, first, held), name)
    carried, at, state = {}, None, none
    for r in sorted(kept.where("__ends is not null").select("__part", "__ends").collect()):  # one row a partition
        start, end, own = pickle.loads(r["__ends"])
        if start == at:
            carried[r["__part"]] = state
        state = compose(state, own) if start == at == end else own
        at = end

    def then(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["__state"] is not None and r["__part"] in carried:
                    before = compose(carried[r["__part"]], pickle.loads(r["__state"]))
                    r.update(zip(final.names[-n_out:], values(r, before, compose(before, element(r))), strict=True))
            yield batch_of([tuple(r[c] for c in final.names) for r in rows], final)

    rows = kept.where("__ends is null")
    if not carried:
        return rows.select(*full.names)
    touched = F.col("__state").isNotNull() & F.col("__part").isin(list(carried))
    return rows.where(~touched).select(*full.names).unionByName(map_arrow(rows.where(touched), then, full))
