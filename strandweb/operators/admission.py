"""Limits of a run: tasks at or below the depth limit are rejected, of the others the first ``max_links`` are admitted.

A null limit is 0, as a message that lacks it would have it. Duplicates use up the budget like any other task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweb.operators.scan import running_total

#: So many admitted tasks of one run are ranked in one task at most; runs with larger budgets are ranked over range partitions.
MOST_IN_TASK = 1_000_000


def within_depth(depth: Column, max_depth: Column) -> Column:
    return F.coalesce(depth, F.lit(0)) < F.coalesce(max_depth, F.lit(0))


def admit(tasks: DataFrame, run: str, order: list[str], left: Column, most: int | None = None, in_task: int = MOST_IN_TASK) -> DataFrame:
    """The admitted ``tasks`` with ``rank``, from 1 in each run, in ``order``. ``left`` is the run's remaining budget.

    ``most`` is the largest budget of any run. Up to ``in_task`` it bounds what a task holds: as a literal it lets Spark keep only so many
    rows of a run in each map task before the shuffle, however many tasks a run has. Beyond it, or where it isn't known, the rows are
    range-partitioned by run and order and ranked piece by piece, so a run with a third of all rows covers many partitions. Both ways
    give the same ranks where ``order`` is total; rows that tie are exact copies to the rank.
    """
    if most is not None and most <= in_task:
        ranked = tasks.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where(F.col("rank") <= most)
    else:
        ranked = running_total(tasks, [run], order, F.lit(1), "rank")
    return ranked.where(F.col("rank") <= left)
