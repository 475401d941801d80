"""Keep-latest over a stream: state of one row a key, with or without a time limit."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stage import staging_folder

UNDATED = -(1 << 62)
# Rows without a key have no state: beside a time limit they pass in as many groups, by their id.
PASSING = 64


def latest_changes(stream: DataFrame, key: Column, date: Column, row_id: str, expires: str | None = None, event_time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of the latest row of each key that a batch names, under the rule of
    dedup.keep_latest(): latest date, undated rows first, then highest row id.

    Adds _key (null: the row has none and passes as it is) and _order (its date).  The
    latest row in what was written of a key is that of the batch operator over all rows
    (current()); of rows with equal key, date and id one stays.

    Without a time limit this is an aggregation with state in the state store, combined
    before its shuffle, so a key that is very common sends one row a task; a key that a
    batch names is written again even where its row stays.

    With `expires` (of time without a record) the state of a key is its latest date and
    id, which goes once the watermark, `delay` behind the largest event_time, is that far
    beyond the key's last record; only changes are written; a key that comes again starts
    anew.  Spark then drops rows that are not after the watermark, so delay and expires
    must exceed the time by which records come late.  Spark has no such limit for an
    aggregation by key alone, so this way goes through pandas, a group a key (about a
    millisecond each), of which tasks send no more than one row for each Arrow batch."""
    if (expires is None) != (event_time is None):
        raise ValueError("expires and event_time go together")
    kind = stream.schema[row_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        raise ValueError(f"row ids must be whole numbers or text, not {kind}")
    marked = stream.withColumns({"_key": F.nullif(key.cast("string"), F.lit("")), "_order": F.coalesce(F.unix_micros(date.cast("timestamp")), F.lit(UNDATED))})
    if expires is not None:
        return _expiring(marked, row_id, kind != "string", int(pd.Timedelta(expires).total_seconds() * 1000), event_time, delay)
    row = F.struct(*(f"`{c}`" for c in (*stream.columns, "_order")))
    last = marked.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max_by(row, F.struct("_order", F.col(row_id))).alias("_row"))
    return last.select("_row.*", "_key").unionByName(marked.where(F.col("_key").isNull()))


def _expiring(marked: DataFrame, row_id: str, whole: bool, limit: int, event_time: str, delay: str) -> DataFrame:
    marked = marked.withColumn("_r", F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    marked = marked.withColumn("_group", F.coalesce(F.concat(F.lit("k"), "_key"), F.concat(F.lit("p"), F.pmod(F.xxhash64("_r"), F.lit(PASSING))))).withWatermark(event_time, delay)
    fields = marked.schema

    def rank(d, r: str):
        return int(d), int(r or -(1 << 63)) if whole else r

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = pd.to_numeric(b["_r"].where(b["_r"] != "", str(-(1 << 63)))).astype("int64") if whole else b["_r"]
            keyed = b["_key"].notna()
            last = pd.DataFrame({"g": b["_group"], "d": b["_order"], "r": r})[keyed].sort_values(["d", "r"], kind="stable").drop_duplicates("g", keep="last")
            yield b[~keyed | b.index.isin(last.index)]

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if group[0][0] == "p":
            for b in batches:
                yield b.drop(columns=["_r", "_group"])
            return
        d, r = state.get if state.exists else (None, None)
        best, now = None, state.getCurrentWatermarkMs()
        for b in batches:
            for k, own in enumerate(zip(b["_order"], b["_r"])):
                if d is None or rank(*own) > rank(d, r):
                    (d, r), best = own, b.iloc[k : k + 1]
        if best is not None:
            state.update((int(d), r))
            seen = best[event_time].iloc[0]
            state.setTimeoutTimestamp(max(now, int(seen.timestamp() * 1000) if pd.notna(seen) else 0) + limit)
            yield best.drop(columns=["_r", "_group"])
        else:  # a timeout holds for one call only: name it again
            state.setTimeoutTimestamp(now + limit)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name not in ("_r", "_group"))
    return marked.mapInPandas(combine, fields).groupBy("_group").applyInPandasWithState(update, out, "d long, r string", "update", GroupStateTimeout.EventTimeTimeout)


def written_changes(changes: DataFrame) -> DataFrame:
    """Runs a stream of changes over all that its source has now, and reads what it
    wrote.  A batch that is repeated after a failure writes its folder anew."""
    path = staging_folder(changes.sparkSession)
    out = changes.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
    out.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/log/{n}")).trigger(availableNow=True).start().awaitTermination()
    return changes.sparkSession.read.schema(changes.schema).parquet(f"{path}/log/*")


def current(changes: DataFrame, row_id: str) -> DataFrame:
    """The table that a written stream of changes stands for: the latest row of each key,
    and every row without one.  One aggregation by key."""
    columns = [c for c in changes.columns if c not in ("_key", "_order")]
    last = changes.where("_key IS NOT NULL").groupBy("_key").agg(F.max_by(F.struct(*(f"`{c}`" for c in columns)), F.struct("_order", F.col(row_id))).alias("_row"))
    return last.select("_row.*").unionByName(changes.where("_key IS NULL").select(*(f"`{c}`" for c in columns)))
