"""Sequential rules on many small groups: a task sorts its groups and hands them over one after another, so a group costs microseconds, not a call of Spark's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

Group = dict[str, np.ndarray]


def map_groups(df: DataFrame, groups: list[str], order: list[str], run: Callable[[Group], tuple[np.ndarray, Group] | None], keep: list[str], extra: str = "", paired: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep` of the rows that `run` names in each group (by place in it), with the columns that it gives for them: those of
    `paired` (by the column they repeat) as places of other rows, those of `extra` (a schema) as values. None is no row.

    `run` gets a group's columns as numpy arrays, in order. A group is held by one task."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    paired = paired or {}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` {kinds[x]}" for c, x in paired.items()), *([extra] if extra else [])])
    target = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def work(table: pa.Table) -> pa.RecordBatch:
        n = len(table)
        new = np.zeros(n, bool)
        new[0] = True
        for c in groups:
            codes = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        rows, more = [], {f.name: [] for f in target if f.name not in keep}
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            found = run({c: x[a:b] for c, x in columns.items()})
            if found is not None and len(found[0]):
                rows.append(a + np.asarray(found[0], np.int64))
                for name, values in more.items():
                    values.append(np.asarray(found[1][name]) + (a if name in paired else 0))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        take = lambda c, parts: table.column(c).take(pa.array(join(parts))).combine_chunks()
        arrays = [take(c, rows) for c in keep]
        arrays += [take(paired[name], v) if name in paired else pa.array(join(v), target.field(name).type) for name, v in more.items()]
        return pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target, strict=True)], names=target.names)

    def apply(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.slice(batch.num_rows - 1, 1).select(groups).to_pylist()[0]
            held.append(batch)
            first = batch.slice(0, 1).select(groups).to_pylist()[0]
            if first == last:  # the last group fills the batch, and may go on
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(len(table), bool)
            for c in groups:
                codes = pc.dictionary_encode(table.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy()
                same &= codes == codes[-1]
            cut = len(table) - int(same[::-1].argmin()) if not same.all() else 0
            yield work(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return df.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(apply, schema)
