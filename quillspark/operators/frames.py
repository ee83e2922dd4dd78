"""Window frames that Spark's SQL lacks: GROUPS, EXCLUDE and FILTER, composed of frames that it has.

GROUPS counts peers: a dense rank numbers the groups of equal order keys, and a RANGE over that number is a frame of whole groups. What
EXCLUDE leaves of a frame is a union of frames (what lies before, among and after the peers), so sums and extremes are put
together from those; only a ROWS frame without the row's peers is a difference, of the frame and of the same offsets among the peers. FILTER
is a condition on the input. Rows are dealt once, to as many tasks as their size asks for, and sorted twice whatever the number of frames: by
the order keys to number them, then by those numbers, which all frames are taken over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Frame:
    """start and end count rows or groups from the current one, None is unbounded; exclude is '', 'current row', 'group' or 'ties'.

    Rows of equal keys stand in the order of `ties`, or in any."""

    partition_by: tuple[str, ...]
    order_by: tuple[str, ...]
    mode: str = "rows"
    start: int | None = None
    end: int | None = 0
    exclude: str = ""
    ties: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in ("rows", "groups") or self.exclude not in ("", "current row", "group", "ties"):
            raise ValueError(f"no frame of {self.mode} without {self.exclude or 'exclusion'}")

    @property
    def bounds(self) -> tuple[int, int]:
        return _FIRST if self.start is None else self.start, _LAST if self.end is None else self.end


#: Bytes of input, as the planner estimates them, that are dealt to one task.
TASK_BYTES, MOST_TASKS = 4 << 20, 1 << 15


def _dealt(df: DataFrame, frame: Frame) -> DataFrame:
    """The rows by partition, in a number of tasks that grows with them, so that what a task sorts doesn't."""
    if not frame.partition_by:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, min(MOST_TASKS, size // TASK_BYTES) if size < 1 << 60 else 0), *frame.partition_by)


def _numbered(df: DataFrame, frame: Frame) -> tuple[DataFrame, str, str]:
    """The rows with the number of their group and their place, under names that the frame doesn't have, in that order."""
    group, row = "_group", "_row"
    while group in df.columns or row in df.columns:
        group, row = group + "_", row + "_"
    keys = Window.partitionBy(*frame.partition_by)
    places = {group: F.dense_rank().over(keys.orderBy(*frame.order_by)), row: F.row_number().over(keys.orderBy(*frame.order_by, *frame.ties))}
    return _dealt(df, frame).withColumns(places).sortWithinPartitions(*frame.partition_by, group, row), group, row


def _parts(frame: Frame, group: str, row: str) -> tuple[list[WindowSpec], list[WindowSpec]]:
    """(frames whose union it is, frames to take away from it)."""
    first, last = frame.bounds
    keys = Window.partitionBy(*frame.partition_by)
    by_row, by_group, peers = keys.orderBy(group, row), keys.orderBy(group), Window.partitionBy(*frame.partition_by, group).orderBy(row)
    rows = lambda w, a, b: [w.rowsBetween(a, b)] if a <= b else []
    groups = lambda a, b: [by_group.rangeBetween(a, b)] if a <= b else []
    if not frame.exclude:
        return (rows(by_row, first, last) if frame.mode == "rows" else groups(first, last)), []
    own = first <= 0 <= last
    if frame.mode == "rows":
        if frame.exclude == "current row":
            return rows(by_row, first, min(last, -1)) + rows(by_row, max(first, 1), last), []
        kept = rows(by_row, 0, 0) if own and frame.exclude == "ties" else []
        return rows(by_row, first, last) + kept, rows(peers, first, last)
    out = groups(first, min(last, -1)) + groups(max(first, 1), last)
    if own and frame.exclude == "ties":
        out += rows(by_row, 0, 0)
    elif own and frame.exclude == "current row":
        out += rows(peers, _FIRST, -1) + rows(peers, 1, _LAST)
    return out, []


def over(df: DataFrame, frame: Frame, **columns: tuple[str, Column | None] | tuple[str, Column | None, Column]) -> DataFrame:
    """The rows with columns name=(function, value[, condition]): sum, count, avg, min or max over the frame of the values that meet
    the condition. count with value None counts rows. An empty frame gives null, or 0 for count; sums of whole numbers are exact."""
    return over_each(df, [(frame, columns)])


def over_each(df: DataFrame, frames: list[tuple[Frame, dict]]) -> DataFrame:
    """The same for several frames of one partition and order, each with its columns."""
    first = frames[0][0]
    if any((x.partition_by, x.order_by, x.ties) != (first.partition_by, first.order_by, first.ties) for x, _ in frames):
        raise ValueError("frames of different partitions or orders")
    numbered, group, row = _numbered(df, first)
    made = {}
    for frame, columns in frames:
        added, removed = _parts(frame, group, row)
        for name, (function, value, *condition) in columns.items():
            value = F.lit(1) if value is None else value
            made[name] = _value(function, F.when(condition[0], value) if condition and condition[0] is not None else value, added, removed)
    return numbered.withColumns(made).drop(group, row)


def _value(function: str, value: Column, added: list[WindowSpec], removed: list[WindowSpec]) -> Column:
    count = _total(F.count(value), added) - _total(F.count(value), removed)
    if function == "count":
        return count
    if function in ("sum", "avg"):
        total = F.when(count > 0, _total(F.sum(value), added) - _total(F.sum(value), removed))
        return total if function == "sum" else total / count
    if function not in ("min", "max"):
        raise ValueError(f"no frame of {function}")
    if removed:
        raise ValueError("a ROWS frame without peers has no min or max here")
    each = [(F.min if function == "min" else F.max)(value).over(w) for w in added]
    return (F.least if function == "min" else F.greatest)(*each) if len(each) > 1 else each[0] if each else F.lit(None)


def _total(function: Column, windows: list[WindowSpec]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(function.over(w), F.lit(0)) for w in windows], F.lit(0))
