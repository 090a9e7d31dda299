"""Running sums over the whole of a sorted table, in parallel.

A task sums its own sorted rows; what stood before them in other tasks is added
afterwards from one row for each task, which is all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, saved, trim


def _folded(values: np.ndarray, xor: bool) -> np.ndarray:
    return np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)


def _summed(columns: list[tuple[int, bool]], group: int | None):
    """Adds the task, whether a row's group may have begun before the task, and sums within the group; then one row on the task itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, lead, schema = TaskContext.get().partitionId(), None, None, True, None
        carried = [0] * len(columns)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = np.zeros(n, np.int64) if group is None else b.column(group).to_numpy()
            starts = np.append(last is not None and g[0] != last, g[1:] != g[:-1])
            first, last = (int(g[0]) if first is None else first), int(g[-1])
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # where a row's group begins in this batch, else -1
            leads = (at < 0) & lead
            lead, sums = bool(leads[-1]), []
            for k, (c, xor) in enumerate(columns):
                total = _folded(b.column(c).to_numpy(), xor)
                before = np.where(at > 0, total[np.maximum(at, 1) - 1], 0)
                if xor:
                    sums.append(total ^ np.where(at < 0, carried[k], before))
                else:
                    sums.append(total - np.where(at < 0, -carried[k], before))
                carried[k] = int(sums[-1][-1])
            schema = b.schema
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(leads), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, sums)], [*schema.names, *OWN, *(f"_sum{k}" for k in range(len(sums)))])
        if schema is not None:
            one = [pa.nulls(1, t) for t in schema.types]
            yield pa.RecordBatch.from_arrays([*one, pa.array([part], pa.int32()), pa.array([lead]), pa.array([first]), pa.array([last]), *(pa.array([c]) for c in carried)], [*schema.names, *OWN, *(f"_sum{k}" for k in range(len(columns)))])
        trim()

    return run


OWN = ["_task", "_lead", "_first", "_last"]


def running(df: DataFrame, order: list[str], sums: dict[str, str], xors: dict[str, str] | None = None, group: str | None = None, name: str = "running") -> DataFrame:
    """``df`` with running sums in the order of the columns ``order``, over rows of one ``group`` (a long, first of ``order``) where given.

    sums, xors: name of each new column, and the long column that is added up or
    folded by exclusive or; each takes in its own row. A group may span tasks.
    Rows alike in ``order`` come in any order. Nulls are not allowed in ``group``
    and the summed columns. The result reads a table in the shared folder.
    """
    made = [*((new, c, False) for new, c in sums.items()), *((new, c, True) for new, c in (xors or {}).items())]
    at = {c: k for k, c in enumerate(df.columns)}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_task int, _lead boolean, _first long, _last long", *(f"_sum{k} long" for k in range(len(made)))])
    own = df.repartitionByRange(parts(df), *order).sortWithinPartitions(*order)
    done = saved(own.mapInArrow(_summed([(at[c], xor) for _, c, xor in made], None if group is None else at[group]), schema), name)
    carry, before, rows = [0] * len(made), None, []
    for t in done.filter("_first is not null").select(*OWN, *(f"_sum{k}" for k in range(len(made)))).orderBy("_task").collect():  # one row for each task
        task, whole, first, last, *own_sums = t
        came = carry if before == first else [0] * len(made)
        rows.append((task, *came))
        carry = [(c ^ s if xor else c + s) if whole else s for c, s, (_, _, xor) in zip(came, own_sums, made)]
        before = last
    came = df.sparkSession.createDataFrame(rows, ", ".join(["_task int", *(f"_came{k} long" for k in range(len(made)))]))
    out = done.filter("_first is null").join(F.broadcast(came), "_task")
    folded = lambda k, xor: F.col(f"_sum{k}").bitwiseXOR(F.col(f"_came{k}")) if xor else F.col(f"_sum{k}") + F.col(f"_came{k}")
    return out.select(*df.columns, *(F.when(F.col("_lead"), folded(k, xor)).otherwise(F.col(f"_sum{k}")).alias(new) for k, (new, _, xor) in enumerate(made)))
