"""The job state machine, over tables and over streams.

A request is a map from states to states. Maps compose, so a job's requests are folded in pieces of bounded length, for
every state that a piece could begin in, and the pieces are then chained.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: States, and where a request leads from each; what is missing is refused.
STATES = ("pending", "ready", "running", "retryable", "failed", "done")
STEPS = {
    "run": {"pending": "running", "ready": "running", "retryable": "running"},
    "retry": {"running": "retryable", "failed": "retryable"},
    "fail": {"running": "failed"},
    "finish": {"running": "done"},
}
PIECE = 10_000


def requests_of_events(events: DataFrame) -> DataFrame:
    """(job, at, seq, request) of events: what each asks of its user's job."""
    asks = F.when(F.col("event_type").isin("signup", "click"), "run").when(F.col("event_type") == "view", "retry").when(F.col("event_type") == "error", "fail").otherwise("finish")
    return events.select(F.col("user_id").alias("job"), "at", F.col("event_id").alias("seq"), asks.alias("request"))


def _step(state: Column, request: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, steps in STEPS.items():
        for a, b in steps.items():
            out = F.when((request == name) & (state == a), b).otherwise(out)
    return out


def _folded(requests: Column, start: str) -> Column:
    """(state, refused) after the requests, from a start state."""
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, r: Column) -> Column:
        to = _step(acc["state"], r["request"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["refused"] + to.isNull().cast("long")).alias("refused"))

    return F.aggregate(requests, zero, step)


def final_states(requests: DataFrame, initial: str = "pending") -> DataFrame:
    """(job, state, refused, n): the state after all requests of each job in order, and how many were refused."""
    w = Window.partitionBy("job").orderBy("at", "seq")
    cut = requests.withColumn("piece", F.floor((F.row_number().over(w) - 1) / PIECE))
    pieces = cut.groupBy("job", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "request"))).alias("requests"))
    ends = F.create_map(*[x for s in STATES for x in (F.lit(s), _folded(F.col("requests"), s))])
    maps = pieces.select("job", "piece", F.size("requests").cast("long").alias("n"), ends.alias("ends"))
    zero = F.struct(F.lit(initial).alias("state"), F.lit(0).cast("long").alias("refused"))
    chain = lambda acc, p: F.struct(p["ends"][acc["state"]]["state"].alias("state"), (acc["refused"] + p["ends"][acc["state"]]["refused"]).alias("refused"))
    order = lambda a, b: F.when(a["piece"] < b["piece"], -1).when(a["piece"] > b["piece"], 1).otherwise(0)
    whole = maps.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("piece", "ends")), order).alias("pieces"), F.sum("n").alias("n"))
    out = whole.withColumn("end", F.aggregate("pieces", zero, chain))
    return out.select("job", F.col("end.state").alias("state"), F.col("end.refused").alias("refused"), "n")


def stream_states(requests: DataFrame, initial: str = "pending") -> DataFrame:
    """As final_states(), over a stream (job, seq, request): the state of each job that a batch touches, in order of seq within it."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, refused, n = state.get if state.exists else (initial, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for request in rows["request"]:
            to = STEPS.get(request, {}).get(current)
            refused, n, current = refused + (to is None), n + 1, to or current
        state.update((current, refused, n))
        yield pd.DataFrame({"job": [key[0]], "state": [current], "refused": [refused], "n": [n]})

    return requests.groupBy("job").applyInPandasWithState(work, "job long, state string, refused long, n long", "state string, refused long, n long", "update", GroupStateTimeout.NoTimeout)
