"""At-least-once messages with retries: done, retry and dead-letter outputs that a replay leaves as they are."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import names_in
from ..operators.state import route_deliveries

#: Gets messages with `receives` (1 the first time) and adds a boolean `ok`; null counts as failed.
Handler = Callable[[DataFrame], DataFrame]


class DeliveryLog:
    """Outputs of deliveries under a shared folder, a folder `batch=n/round=k/route=...` for each step.

    Round 0 of a batch takes the batch's new messages and what the step before it left to retry; a further round, made by `redrive`, takes
    only the latter. A step's three outputs are written by one job and count once its marker is there, so a step that is run again
    after a failure reads the same input and replaces its own output: no message is done or dead twice.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType):
        """schema is that of the messages: any columns but `receives`, `ok` and `route`, among them `task`."""
        self.spark, self.base, self.schema = spark, base, schema

    def steps(self) -> list[tuple[int, int]]:
        """(batch, round) of the complete steps, in order."""
        found = []
        for batch in names_in(self.spark, self.base):
            for step in names_in(self.spark, f"{self.base}/{batch}"):
                at = re.fullmatch(r"batch=(\d+)/round=(\d+)", f"{batch}/{step}")
                if at and "_SUCCESS" in names_in(self.spark, f"{self.base}/{batch}/{step}"):
                    found.append((int(at[1]), int(at[2])))
        return sorted(found)

    def _rows(self, steps: list[tuple[int, int]], routes: tuple[str, ...]) -> DataFrame:
        kept = T.StructType([*self.schema.fields, T.StructField("receives", T.IntegerType()), T.StructField("route", T.StringType())])
        folders = [f"{self.base}/batch={b}/round={r}" for b, r in steps]
        paths = [f"{f}/{n}" for f in folders for n in names_in(self.spark, f) if n in {f"route={x}" for x in routes}]
        if not paths:
            return self.spark.createDataFrame([], kept)
        return self.spark.read.schema(kept).option("basePath", self.base).parquet(*paths).select(*kept.names)

    def read(self, *routes: str) -> DataFrame:
        """All messages of the routes done and dead, and those that wait for another try under retry; with `receives` and `route`."""
        steps = self.steps()
        ended = self._rows(steps, tuple(r for r in routes if r != "retry"))
        return ended.unionByName(self._rows(steps[-1:], ("retry",))) if "retry" in routes else ended

    def waiting(self, before: tuple[int, int]) -> DataFrame:
        """What the last complete step before this one left to retry."""
        return self._rows([s for s in self.steps() if s < before][-1:], ("retry",)).drop("route")

    def step(self, at: tuple[int, int], fresh: DataFrame | None, handle: Handler, tasks: tuple[str, ...], max_receive: int) -> None:
        """One try of what waits and of fresh messages, written as step `at`."""
        again = self.waiting(at).withColumn("receives", F.col("receives") + 1)
        rows = again if fresh is None else again.unionByName(fresh.select(*self.schema.names).withColumn("receives", F.lit(1)))
        known = F.coalesce(F.col("task").isin(*tasks), F.lit(False))
        routed = route_deliveries(handle(rows), "receives", F.col("ok"), known, max_receive)
        routed.select(*self.schema.names, "receives", "route").write.mode("overwrite").partitionBy("route").parquet(f"{self.base}/batch={at[0]}/round={at[1]}")


def deliver_stream(messages: DataFrame, log: DeliveryLog, handle: Handler, tasks: tuple[str, ...], max_receive: int = 3) -> None:
    """Runs a stream of messages through handle over what is there, a step a batch; a restart with the same log goes on where it stopped.

    A message whose task isn't among tasks fails like one that handle gives no true `ok`; once received max_receive times it goes to the
    dead-letter output, before that to the next batch.
    """
    each = lambda batch, n: log.step((n, 0), batch, handle, tasks, max_receive)
    started = messages.writeStream.foreachBatch(each).option("checkpointLocation", f"{log.base}-state").trigger(availableNow=True)
    started.start().awaitTermination()


def redrive(log: DeliveryLog, handle: Handler, tasks: tuple[str, ...], max_receive: int = 3) -> bool:
    """Another round of what the last step left to retry, without new messages; False if nothing waits. No stream may write to the log meanwhile."""
    steps = log.steps()
    if not steps or "route=retry" not in names_in(log.spark, f"{log.base}/batch={steps[-1][0]}/round={steps[-1][1]}"):
        return False
    batch, last = steps[-1]
    log.step((batch, last + 1), None, handle, tasks, max_receive)
    return True
