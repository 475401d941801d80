"""Valuation of a stream of targets against a static market (stream-static join)."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.knn import value_targets
from ..sources.stage import scope


def value_stream(market: DataFrame, targets: DataFrame, last_year: int, sink, checkpoint: str, **how):
    """Values each micro-batch of a streaming targets table and hands the result to
    sink(DataFrame, batch_id), which writes or collects it before it returns: what the
    batch staged is removed then.  Returns the started query."""

    def run(batch: DataFrame, n: int) -> None:
        with scope():
            sink(value_targets(market, batch, last_year, **how), n)

    return targets.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
