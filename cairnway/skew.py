"""Group-ordered work that stays exact when one group holds much of the table.

A window over a key puts every row of that key into one task. The helpers below look at the
widest group first (a partial aggregate: only counts travel) and use the plain window when it
is small enough for a task. Beyond that bound the same result comes from range partitions or
from fixed-size runs of positions, so no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from cairnway.session import cut

# Rows of one group that a single task may hold and sort comfortably.
TASK_ROWS = 2_000_000
# Length of a run of positions; neighbouring runs share one row.
RUN_ROWS = 65_536

_widths: dict[tuple, int] = {}


def widest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group, remembered per plan so that one session counts once."""
    token = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys))
    if token not in _widths:
        row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
        _widths[token] = int(row["n"] or 0)
    return _widths[token]


def narrow(df: DataFrame, keys: Sequence[str], bound: int | None = None, width: int | None = None) -> bool:
    """``width``, where the caller knows that no group has more rows, saves the count.

    A count runs all that ``df`` is made of, so a chain of helpers that count for themselves
    repeats its beginning once per helper.
    """
    return (widest(df, keys) if width is None else width) <= (TASK_ROWS if bound is None else bound)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``, a batch and its last group at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        start = int(keys.searchsorted(keys[-1]))
        if start or (held and last != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group.

    ``row_number() <= n`` is planned with a group limit below the shuffle, so each map task
    sends at most ``n`` rows per group whatever the group holds.
    """
    rank = name or "_rank"
    ranked = df.withColumn(
        rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    ).where(F.col(rank) <= n)
    return ranked if name else ranked.drop(rank)


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """1-based place of each row in its group under a total order.

    ``width`` is the size of the widest group, or more, where the caller has counted it already.
    """
    if narrow(df, keys, bound, width):
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    # Sort the table into ranges, number the rows inside each (group, range), and add the
    # rows of the ranges before it. The cut fixes which row lies in which range.
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        df.repartitionByRange(count, *[F.col(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_inside", F.row_number().over(inside).cast("long"))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_range", "_inside", "_before")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    halo: int = 1,
    dense: bool = True,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Window columns whose frames reach at most ``halo`` rows to either side.

    ``pos`` counts 1, 2, ... inside each group; with ``dense=False`` it only orders the rows.
    """
    if narrow(df, keys, bound, width):
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(pos)))
    # Fixed-size runs; the rows next to a run are copied into it and dropped after.
    place = pos
    if not dense:
        place = "_place"
        df = position(df, keys, [F.col(pos)], place, bound, width)
    size = F.lit(RUN_ROWS if bound is None else max(bound, halo + 1))
    index = F.col(place) - 1
    home = F.floor(index / size)
    runs = F.array_distinct(
        F.array(home, F.floor((index - halo) / size), F.floor((index + halo) / size))
    )
    spread = df.withColumn("_home", home).withColumn("_run", F.explode(runs))
    return (
        spread.withColumns(columns(Window.partitionBy(*keys, "_run").orderBy(place)))
        .where(F.col("_run") == F.col("_home"))
        .drop("_run", "_home", "_place")
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    following: dict[str, str] | None = None,
    preceding: dict[str, str] | None = None,
    dense: bool = True,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Values of the next and previous row, as ``{column: new name}``."""

    def shifted(window: WindowSpec) -> dict[str, Column]:
        return {
            **{new: F.lead(old).over(window) for old, new in (following or {}).items()},
            **{new: F.lag(old).over(window) for old, new in (preceding or {}).items()},
        }

    return framed(df, keys, pos, shifted, 1, dense, bound, width)


def with_group(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Aggregates of the group next to each of its rows."""
    if narrow(df, keys, bound, width):
        window = Window.partitionBy(*keys)
        return df.withColumns({name: value.over(window) for name, value in values.items()})
    totals = df.groupBy(*keys).agg(*[value.alias(name) for name, value in values.items()])
    return df.join(totals, list(keys))


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """The first non-null ``value`` at or after this row."""
    back = (Window.unboundedPreceding, Window.currentRow)
    if narrow(df, keys, bound, width):
        window = Window.partitionBy(*keys).orderBy(F.col(pos).desc()).rowsBetween(*back)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(window))
    size = F.lit(RUN_ROWS if bound is None else bound)
    runs = df.withColumn("_run", F.floor((F.col(pos) - 1) / size))
    later = Window.partitionBy(*keys).orderBy(F.col("_run").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = (
        runs.groupBy(*keys, "_run")
        .agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_first"))
        .withColumn("_later", F.last("_first", ignorenulls=True).over(later))
        .drop("_first")
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(F.col(pos).desc()).rowsBetween(*back)
    return (
        runs.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(firsts, [*keys, "_run"])
        .withColumn(name, F.coalesce("_inside", "_later"))
        .drop("_run", "_inside", "_later")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """Sum of ``value`` from the start of the group to this row."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if narrow(df, keys, bound, width):
        window = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*upto)
        return df.withColumn(name, F.sum(value).over(window))
    size = F.lit(RUN_ROWS if bound is None else bound)
    runs = df.withColumn("_run", F.floor((F.col(pos) - 1) / size))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        runs.groupBy(*keys, "_run")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(pos).rowsBetween(*upto)
    return (
        runs.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*keys, "_run"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_run", "_inside", "_before")
    )


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str,
    bound: int | None = None,
    width: int | None = None,
) -> DataFrame:
    """The greatest ``value`` of the rows before this one."""
    before = (Window.unboundedPreceding, -1)
    if narrow(df, keys, bound, width):
        window = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*before)
        return df.withColumn(name, F.max(value).over(window))
    size = F.lit(RUN_ROWS if bound is None else bound)
    runs = df.withColumn("_run", F.floor((F.col(pos) - 1) / size))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(*before)
    offsets = (
        runs.groupBy(*keys, "_run")
        .agg(F.max(value).alias("_most"))
        .withColumn("_before", F.max("_most").over(earlier))
        .drop("_most")
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(pos).rowsBetween(*before)
    return (
        runs.withColumn("_inside", F.max(value).over(inside))
        .join(offsets, [*keys, "_run"])
        .withColumn(name, F.greatest("_inside", "_before"))
        .drop("_run", "_inside", "_before")
    )
