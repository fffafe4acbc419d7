"""Analysis of functions as they arrive: a function's facts depend on no other, so each batch stands alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import kernel


def analyse(functions: DataFrame, *columns: str) -> DataFrame:
    """The facts of a stream of packed functions: a map, so nothing is kept between batches."""
    return kernel.facts(functions, *columns)


def start(functions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *columns: str, once: bool = True) -> StreamingQuery:
    """Hands each batch's facts to ``sink`` with its number, which repeats if the batch does."""
    w = analyse(functions, *columns).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
