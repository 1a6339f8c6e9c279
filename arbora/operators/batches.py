"""Groups of rows in NumPy, many small ones a batch: tiny rasters cost no exchange with Python each, and a large one is a group like any other."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute in tasks)
from pyspark.sql import DataFrame

ROWS = 1 << 16  #: rows given back at a time, about
CELLS = 1 << 18  #: cells of a stack of arrays, about; one array may be larger


def _whole_groups(iterator, keys: list[str]):
    """(rows, starts of their groups) of sorted batches; a group that goes on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []

    def cut(rows: pa.Table):
        fresh = np.zeros(rows.num_rows, bool)
        fresh[0] = True
        for k in keys:
            column = rows.column(k).combine_chunks()
            fresh[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, len(column) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        return np.flatnonzero(fresh)

    for batch in iterator:
        if not batch.num_rows:
            continue
        starts = cut(pa.Table.from_batches([batch]))
        if waiting:
            ends = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)])
            starts = starts if len(cut(ends)) > 1 else starts[1:]
        if not len(starts):
            waiting.append(batch)
            continue
        last = int(starts[-1])
        rows = pa.Table.from_batches([*waiting, batch.slice(0, last)] if last else waiting) if waiting or last else None
        if rows is not None and rows.num_rows:
            yield rows.combine_chunks(), cut(rows)
        waiting = [batch.slice(last)]
    if waiting:
        rows = pa.Table.from_batches(waiting)
        yield rows.combine_chunks(), cut(rows)


def by_groups(df: DataFrame, keys: list[str], make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The ``keys`` and what ``make`` returns (the columns of ``schema``) for the rows of each group, given as arrays by column, keys included; see ``by_many``."""
    name = schema.split()[0]

    def each(px: dict[str, np.ndarray], starts: np.ndarray):
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(px[keys[0]])]):
            out = make({c: v[a:b] for c, v in px.items()})
            yield np.full(len(out[name]), a), out

    return by_many(df, keys, each, schema)


def by_many(df: DataFrame, keys: list[str], make: Callable[[dict[str, np.ndarray], np.ndarray], Iterable[tuple[np.ndarray, dict[str, np.ndarray]]]], schema: str) -> DataFrame:
    """The ``keys`` and what ``make`` gives (the columns of ``schema``) for whole groups, many at a time.

    ``make`` takes arrays by column, keys included, of groups that follow each other, and where these start; it gives, piece by piece, for each row it makes a row of its group, and the columns.
    Nulls are nan in numbers; a null key is a group for each of its rows. The number of partitions is given, as groups are work that their bytes do not
    show: by these, Spark would bring thousands of them together in a few tasks.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {c: df.schema[c].dataType.simpleString() for c in keys}

    def run(iterator):
        parts, at, size = [], [], 0

        def made(rows: pa.Table):
            which = pa.array(np.concatenate(at))
            columns = [rows.column(k).combine_chunks().take(which) for k in keys]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(np.concatenate([p[n] for p in parts])) for n in names]], names=[*keys, *names])

        for rows, starts in _whole_groups(iterator, keys):
            for group, out in make({c: rows.column(c).to_numpy() for c in rows.column_names}, starts):
                if len(group):
                    parts.append(out)
                    at.append(group)
                    size += len(group)
                if size >= ROWS:
                    yield made(rows)
                    parts, at, size = [], [], 0
            if parts:
                yield made(rows)
                parts, at, size = [], [], 0

    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + f", {schema}")


def stacks(starts: np.ndarray, n_rows: int, kinds: np.ndarray):
    """Groups whose arrays can be stacked: those with equal rows of ``kinds`` (height and width of a group's array first), as many as make ``CELLS``.

    Gives the kind, the first row of each stacked group, and of all their rows the number and the place in the stack.
    """
    sizes = np.diff(np.append(starts, n_rows))
    order = np.lexsort(kinds.T[::-1])
    ends = np.flatnonzero((kinds[order[1:]] != kinds[order[:-1]]).any(axis=1)) + 1
    for alike in np.split(order, ends):
        kind = kinds[alike[0]].tolist()
        step = max(1, CELLS // max(1, kind[0] * kind[1]))
        for k in range(0, len(alike), step):
            some = alike[k : k + step]
            counts = sizes[some]
            rows = np.arange(counts.sum()) + np.repeat(starts[some] - (np.cumsum(counts) - counts), counts)
            yield kind, starts[some], rows, np.repeat(np.arange(len(some)), counts)
