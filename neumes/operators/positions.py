"""Row numbers and running sums within groups of any size, from ranges of the sorted rows and offsets of the ranges.

A window would sort each group in one task. Here the rows are dealt to ranges of
(groups, order), so that one large group takes many tasks; each task numbers its
own range, and only the first and last group of a range need what earlier ranges
hold of them: two rows a range, which are summed and broadcast.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neumes.sources.tables import written

_PART, _EDGE = "__range", "__edge"


def _numbered(groups: Sequence[str], sums: Sequence[str], names: Sequence[str]):
    """Numbers the sorted rows of one range; in memory are a range's rows, whose share of the table is one by the number of ranges."""

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        n, new = rows.num_rows, np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in groups:
            codes = pc.dictionary_encode(rows[name].combine_chunks(), null_encoding="encode")
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        begin = np.flatnonzero(new)
        group, size = np.cumsum(new) - 1, np.diff(np.append(begin, n))
        added = [np.arange(n) - begin[group] + 1, size[group]]
        for name in sums:
            values = rows[name].combine_chunks().to_numpy(zero_copy_only=False)
            values = np.nan_to_num(values).astype(np.int64) if pa.types.is_integer(rows[name].type) else np.nan_to_num(values)
            # sums start anew in each group, so that they don't depend on the other groups of a range
            upto = np.concatenate([np.cumsum(values[b : b + s]) for b, s in zip(begin, size)]) if values.dtype.kind == "f" else np.cumsum(values)
            if values.dtype.kind != "f":
                upto = upto - (upto[begin] - values[begin])[group]
            added += [upto, upto[begin + size - 1][group]]
        edge = np.where(group == 0, 1, np.where(group == len(begin) - 1, 2, 0))
        for name, column in zip(names, [*added, np.full(n, part), edge]):
            rows = rows.append_column(name, pa.array(column))
        yield from rows.to_batches(max_chunksize=65536)

    return run


def positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """df with ``position`` (row number in the group, from 1), ``group_rows``, and ``upto_<s>`` and ``total_<s>`` for each of ``sums``.

    Rows are dealt evenly if (groups, order) hardly repeat; rows with equal values of
    both are numbered in any order, and lie in one range. Nulls make a group of their
    own and come first; null amounts count as 0. Amounts are whole numbers or doubles.
    The numbered ranges are written to the shared folder, so that a lost executor
    can't make two passes disagree about where ranges begin. An empty table stays empty.
    """
    if not groups:
        return positions(df.withColumn("__all", F.lit(0)), ["__all"], order, sums, ranges).drop("__all")
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {s: T.DoubleType() if isinstance(df.schema[s].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for s in sums}
    fields = [T.StructField("position", T.LongType()), T.StructField("group_rows", T.LongType())]
    for s in sums:
        fields += [T.StructField(f"upto_{s}", kinds[s]), T.StructField(f"total_{s}", kinds[s])]
    fields += [T.StructField(_PART, T.LongType()), T.StructField(_EDGE, T.LongType())]
    keys = [*groups, *order]
    ranged = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    run = _numbered(tuple(groups), tuple(sums), tuple(f.name for f in fields))
    local = written(ranged.mapInArrow(run, T.StructType([*df.schema.fields, *fields])), "positions")
    shares = ["group_rows", *(f"total_{s}" for s in sums)]
    edges = local.filter(F.col(_EDGE) > 0).groupBy(_PART, _EDGE).agg(*(F.first(g).alias(g) for g in groups), *(F.max(s).alias(s) for s in shares))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    moved = {"group_rows": "position"} | {f"total_{s}": f"upto_{s}" for s in sums}
    offsets = edges.select(
        _PART, _EDGE, *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__before_{s}") for s in shares), *(F.sum(s).over(whole).alias(f"__whole_{s}") for s in shares)
    )
    out = local.join(F.broadcast(offsets), [_PART, _EDGE], "left")  # two rows a range at most
    out = out.withColumns({moved[s]: F.col(moved[s]) + F.coalesce(F.col(f"__before_{s}"), F.lit(0)) for s in shares} | {s: F.coalesce(F.col(f"__whole_{s}"), F.col(s)) for s in shares})
    return out.select(*df.columns, "position", "group_rows", *(c for s in sums for c in (f"upto_{s}", f"total_{s}")))
