"""Session logs as a stream: calls wait for their results, and a line's first owner keeps it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphweft.sources.records import LogTail

ANSWERED = "log string, call_id string, kind string, at long, is_error boolean"
EVENT = ("log", "call_id", "kind", "at", "is_call", "is_error")
OPEN_CALLS = "log array<string>, call_id array<string>, kind array<string>, at array<long>"
#: Groups that calls are dealt to; fixed, as the state is kept by it.
SHARES = 1 << 12


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines appended to the logs below folder: offsets are bytes, so a restart reads on where it stopped."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", folder).load()


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The calls of one share: each is put out when its result comes, now or in a later batch."""
    calls = {(log, call_id): (kind, at) for log, call_id, kind, at in zip(*state.get, strict=True)} if state.exists else {}
    known, results = set(calls), {}
    for pdf in frames:
        for log, call_id, kind, at, is_call, is_error in zip(*(pdf[c].tolist() for c in EVENT), strict=True):
            one = (log, call_id)
            if not is_call:
                if one not in results or at < results[one][0]:
                    results[one] = (at, bool(is_error))
            elif one not in known and (one not in calls or at < calls[one][1]):
                calls[one] = (kind, int(at))
    done = []
    for one in results.keys() & calls.keys():
        (kind, at), (_, is_error) = calls.pop(one), results[one]
        if not is_error or kind == "plan":
            done.append((*one, kind, at, is_error))
    if calls:
        state.update(tuple(map(list, zip(*((*one, *call) for one, call in calls.items()), strict=True))))
    elif state.exists:
        state.remove()
    if done:
        yield pd.DataFrame(done, columns=["log", "call_id", "kind", "at", "is_error"])


def pending_calls(events: DataFrame) -> DataFrame:
    """Answered calls of a stream (log, call_id, kind, at, is_call, is_error); unanswered ones are carried between batches.

    Calls are dealt by hash to SHARES, whose state is their open calls: most calls are a row or two, and a Python call
    for each would take longer than all else.
    """
    share = F.pmod(F.xxhash64("log", "call_id"), F.lit(SHARES)).alias("share")
    return events.select(share, *EVENT).groupBy("share").applyInPandasWithState(_pair, ANSWERED, OPEN_CALLS, "append", GroupStateTimeout.NoTimeout)


def first_lines(lines: DataFrame) -> DataFrame:
    """Lines of a stream whose uuid wasn't seen before. Exact, so the state is all uuids."""
    return lines.dropDuplicates(["uuid"])


def tool_events(skimmed: DataFrame) -> DataFrame:
    """Calls and results of skimmed lines in one stream, as pending_calls takes it."""
    part = skimmed.where("not bad").select(F.col("path").alias("log"), F.col("offset").alias("at"), F.explode("message.content").alias("c")).where("c.type in ('tool_use', 'tool_result')")
    call = F.col("c.type") == "tool_use"
    return part.select("log", F.when(call, F.col("c.id")).otherwise(F.col("c.tool_use_id")).alias("call_id"), F.when(call, F.lower("c.name")).alias("kind"), "at", call.alias("is_call"), F.coalesce("c.is_error", F.lit(False)).alias("is_error"))
