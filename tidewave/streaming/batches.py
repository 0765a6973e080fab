"""Signals that arrive in files: each micro-batch goes through a batch operator. Windows are by sample, full ones only.

`follow` takes each batch as it comes; `follow_whole` holds the rows of a recording back until all of it is there, however many
batches it is spread over, so that filters and splines see it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _written_once(operator: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each


def follow(spark: SparkSession, path: str, schema: T.StructType, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """New Parquet recordings below `path` through the operator, the results to `out`, each batch once (told by its number)."""
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(_written_once(operator, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_recordings(stream: DataFrame, size: str, key: str = "k", order: str = "t", value: str = "v", quiet_ms: int | None = None) -> DataFrame:
    """Rows (key, order, value) of recordings, given out once all are there: when as many places are held as the column `size` says.

    Rows may come in any order; of those with one place the last to come counts. With `quiet_ms` a recording that gets no row for
    so long is given out as it is (for queries that go on: the timeout keeps one that takes what is there from ending). The state is one recording a key; rows of a key that come after it was given out begin another.
    """
    kinds = dict(stream.dtypes)

    def hold(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, values, want = state.get if state.exists else ([], [], 0)
        held = dict(zip(places, values, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                held.update(zip(part[order].tolist(), part[value].tolist(), strict=True))
                want = max(want, int(part[size].max()))
        if state.hasTimedOut or len(held) >= want:
            state.remove()
            at = sorted(held)
            yield pd.DataFrame({key: keys[0], order: at, value: [held[i] for i in at]})
        else:
            state.update((list(held), list(held.values()), want))
            if quiet_ms is not None:
                state.setTimeoutDuration(quiet_ms)

    rows = stream.select(key, order, value, size).groupBy(key)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"
    return rows.applyInPandasWithState(hold, out, f"places array<{kinds[order]}>, held array<{kinds[value]}>, want long", "append", GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def follow_whole(spark: SparkSession, path: str, schema: T.StructType, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, size: str) -> StreamingQuery:
    """follow() of whole_recordings()."""
    rows = whole_recordings(spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path), size)
    return rows.writeStream.foreachBatch(_written_once(operator, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
