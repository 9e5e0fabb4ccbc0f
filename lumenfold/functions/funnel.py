"""A table function: who went through the steps of a funnel, by an automaton over each user's rows in order of time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

RESULT = "key long, first_id long, second_id long, last_id long, micros long"


@udtf(returnType=RESULT, useArrow=True)
class Funnel:
    """Rows key, step (1, 2 or 3), at (micros), id, limit of one key, in order. Per last step: the last second step before it, and the last first step before that.

    What is kept are two places, however many rows a key has; rows come in Arrow batches.
    """

    def __init__(self) -> None:
        self.first = self.pair = None

    def eval(self, row) -> Iterator[tuple]:
        step, at = row["step"], row["at"]
        if step == 1:
            self.first = (at, row["id"])
        elif step == 2:
            self.pair = (self.first, row["id"])
        elif self.pair and self.pair[0] and at - self.pair[0][0] <= row["limit"]:
            yield row["key"], self.pair[0][1], self.pair[1], row["id"], at - self.pair[0][0]


def funnel(events: DataFrame, by: str, on: str, id_: str, kind: str, steps: tuple[str, str, str], limit_seconds: int) -> DataFrame:
    """RESULT: the funnels of three steps that end within the limit of their first step.

    Cases: rows at one time are in order of their ids; null keys, times, ids and kinds are left out; a step that repeats counts with its
    last row; rows that repeat end a funnel each; an empty table gives no row.
    """
    step = F.when(F.col(kind) == steps[0], 1).when(F.col(kind) == steps[1], 2).when(F.col(kind) == steps[2], 3)
    rows = events.select(F.col(by).cast("long").alias("key"), step.alias("step"), F.unix_micros(F.col(on).cast("timestamp")).alias("at"), F.col(id_).cast("long").alias("id"), F.lit(limit_seconds * 1_000_000).cast("long").alias("limit"))
    return Funnel(rows.dropna().asTable().partitionBy("key").orderBy("at", "id"))
