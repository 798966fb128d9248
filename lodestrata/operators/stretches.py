"""Order-dependent scans over keys of any size.

Rows are range-partitioned and sorted by key and order, so a key with a third of all rows is spread over many tasks, each of
which scans its stretch as a stream. What a stretch cannot know, because its first key began before it, is settled from
the ends of the stretches, of which there is a fixed number per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from lodestrata.session import durable, parallelism


def scan(frame: DataFrame, order: list[str | Column], step: Callable[[int, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The rows that ``step(number of the stretch, its rows in order)`` gives, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        yield from step(TaskContext.get().partitionId(), batches)

    spread = frame.repartitionByRange(parallelism(frame.sparkSession), *order).sortWithinPartitions(*order)
    return durable(spread.mapInPandas(run, schema))
