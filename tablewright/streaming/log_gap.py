"""Gaps between messages of a log that is still being written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 512  # groups of keys that share a state; fixed for the life of a checkpoint
KEY = ["key", "key_none"]
ROW = [*KEY, "micros", "tie", "tie_none"]
IN_ORDER = [*KEY, "micros", "tie_none", "tie"]


def _whole(df: DataFrame, name: str) -> Column:
    """A column without NULL, which pandas would turn whole numbers into floats for."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(name, F.lit(0).cast(kind))
    return F.coalesce(name, F.lit("")) if isinstance(kind, T.StringType) else F.col(name)


def _messages(stream_df: DataFrame, key: str, tie: str, at: Column, buckets: int, *more: str) -> tuple[DataFrame, str, str]:
    """Rows (bucket, key, tie, micros) with flags for NULL, and the types of key and tie.

    A key that is no whole number travels as text, which tells keys apart as well.
    """
    rows = stream_df.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(at).alias("micros"), *more)
    if not isinstance(rows.schema["key"].dataType, T.IntegralType):
        rows = rows.withColumn("key", F.col("key").cast("string"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = rows.select(
        bucket.alias("bucket"), "micros", *more, _whole(rows, "key").alias("key"), F.isnull("key").alias("key_none"),
        _whole(rows, "tie").alias("tie"), F.isnull("tie").alias("tie_none"),
    )
    return rows, rows.schema["key"].dataType.simpleString(), rows.schema["tie"].dataType.simpleString()


def _last_of(keys: list, nones: list, lasts: list) -> pd.DataFrame:
    return pd.DataFrame({"key": list(keys), "key_none": list(nones), "last": pd.array(list(lasts), dtype="Int64")})


def _before(rows: pd.DataFrame, last: pd.DataFrame) -> tuple[pd.Series, pd.DataFrame]:
    """The time before each row of sorted ``rows``, of its key, and the last time of every key after them."""
    same = pd.Series(True, index=rows.index)
    for values in (rows[name].to_numpy() for name in KEY):
        same &= np.append(False, values[1:] == values[:-1])
    prev = rows["micros"].astype("Int64").shift(1)
    prev[~same] = _known(rows.loc[~same], last)
    new = rows[[*KEY, "micros"]].rename(columns={"micros": "last"}).astype({"last": "Int64"})
    both = pd.concat([f for f in (last, new) if len(f)] or [last], ignore_index=True)
    return prev, both.drop_duplicates(KEY, keep="last")


def _known(rows: pd.DataFrame, last: pd.DataFrame):
    """The last time of the key of each row, NA for a new key."""
    if not len(last) or not len(rows):
        return pd.array([pd.NA] * len(rows), dtype="Int64")
    return rows[KEY].merge(last, "left", KEY)["last"].array


def _named(out: DataFrame, rows: DataFrame, key: str, ts: str, tie: str, *more: str) -> DataFrame:
    return out.select(
        F.when(~F.col("key_none"), F.col("key")).cast(rows.schema[key].dataType).alias(key),
        F.when(~F.col("tie_none"), F.col("tie")).alias(tie),
        F.timestamp_micros("micros").alias(ts),
        F.timestamp_micros("prev").alias("prev_time"),
        (F.col("micros") - F.col("prev")).alias("gap_us"),
        *more,
    )


def stream_log_gap(stream_df: DataFrame, key: str, ts: str, tie: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, tie, ts, prev_time, gap_us, late) per message, the last time of every key kept as state.

    Times pass through the state as microseconds. A message older than the state of its key has no
    right predecessor any more: it comes out flagged ``late`` with no gap and leaves the state alone.
    Messages of one micro-batch are sorted first; the size of a batch is set by the source
    (``maxFilesPerTrigger`` and the like), which also bounds what one key can bring at once. Keys are
    dealt to ``buckets`` by hash, and all keys of a bucket are worked on at once.
    """
    rows, key_type, tie_type = _messages(stream_df, key, tie, F.col(ts).cast("timestamp"), buckets)

    def gaps(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))[ROW].sort_values(IN_ORDER, ignore_index=True)
        last = _last_of(*(state.get if state.exists else ([], [], [])))
        late = (pdf["micros"] < pd.Series(_known(pdf, last))).fillna(False).astype(bool)
        fresh = pdf[~late]
        if len(fresh):
            prev, last = _before(fresh, last)
            state.update((last["key"].tolist(), last["key_none"].tolist(), last["last"].tolist()))
            yield fresh.assign(prev=prev, late=False)
        if late.any():
            yield pdf[late].assign(prev=pd.array([pd.NA] * int(late.sum()), dtype="Int64"), late=True)

    out = rows.groupBy("bucket").applyInPandasWithState(
        gaps,
        outputStructType=f"key {key_type}, key_none boolean, micros bigint, tie {tie_type}, tie_none boolean, prev bigint, late boolean",
        stateStructType=f"keys array<{key_type}>, nones array<boolean>, lasts array<bigint>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return _named(out, stream_df, key, ts, tie, "late")


def stream_log_gap_ordered(stream_df: DataFrame, key: str, ts: str, tie: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, tie, ts, prev_time, gap_us) per message in the order of their times, whatever order they come in.

    Messages wait in the state until the watermark, ``delay`` behind the latest time seen,
    has passed them; then they come out sorted, each with the gap that the batch job gives it. The state
    holds what arrives within one delay. A message later than that is dropped by the watermark and counted
    in the progress of the query (``numRowsDroppedByWatermark``). Messages of the last delay come out when
    later ones move the watermark on. Keys are dealt to ``buckets`` as in :func:`stream_log_gap`.
    """
    seen = stream_df.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    rows, key_type, tie_type = _messages(seen, key, tie, F.col("_at"), buckets, "_at")

    def release(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else tuple([] for _ in range(8))
        last = _last_of(*held[:3])
        waiting = [pd.DataFrame({name: list(values) for name, values in zip(ROW, held[3:])})]
        if not state.hasTimedOut:
            waiting += [b[ROW] for b in batches]
        pdf = pd.concat([w for w in waiting if len(w)] or waiting[:1], ignore_index=True).astype({"micros": "int64"})
        passed = state.getCurrentWatermarkMs()
        ready = pdf["micros"] <= passed * 1000
        out, rest = pdf[ready].sort_values(IN_ORDER, ignore_index=True), pdf[~ready]
        if len(out):
            prev, last = _before(out, last)
            yield out.assign(prev=prev)
        kept = [last[c].tolist() for c in [*KEY, "last"]] + [rest[c].tolist() for c in ROW]
        state.update(tuple(kept))
        if len(rest):
            state.setTimeoutTimestamp(max(passed + 1, -(-int(rest["micros"].min()) // 1000)))

    out = rows.groupBy("bucket").applyInPandasWithState(
        release,
        outputStructType=f"key {key_type}, key_none boolean, micros bigint, tie {tie_type}, tie_none boolean, prev bigint",
        stateStructType=(
            f"keys array<{key_type}>, nones array<boolean>, lasts array<bigint>, waiting array<{key_type}>, "
            f"waiting_none array<boolean>, micros array<bigint>, ties array<{tie_type}>, ties_none array<boolean>"
        ),
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return _named(out, stream_df, key, ts, tie)


def write_log_gap(stream_df: DataFrame, key: str, ts: str, tie: str, target: str, checkpoint: str, delay: str | None = None):
    """Run the job over what has arrived so far, into Parquet, and give the finished query.

    With ``delay`` messages are put in order first, see :func:`stream_log_gap_ordered`.
    """
    gaps = stream_log_gap(stream_df, key, ts, tie) if delay is None else stream_log_gap_ordered(stream_df, key, ts, tie, delay)
    query = (
        gaps.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
