"""Ordered state over streams: deduplicated shards and early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exactly_once(facts: DataFrame, identity: list[str]) -> DataFrame:
    """Each fact once by its identity; works on streams (state by identity) and on tables alike."""
    return facts.dropDuplicates(identity)


def early_stops(losses: DataFrame, patience: int, delta: float = 0.0) -> DataFrame:
    """``(run, step, loss)`` -> the stopping step of each run (null: none): no loss strictly below best - delta for ``patience`` steps.

    With ``delta`` 0 the best is a running minimum, and all is windows; else it depends on which losses counted, and a run is one
    ordered fold over its array of losses.
    """
    if delta:
        step = "if(s.stop is not null, s, if(x.loss < s.best - {0}, named_struct('best', x.loss, 'wait', 0, 'stop', s.stop), named_struct('best', s.best, 'wait', s.wait + 1, 'stop', if(s.wait + 1 >= {1}, x.step, s.stop))))"
        fold = f"aggregate(l, named_struct('best', double('infinity'), 'wait', 0, 'stop', cast(null as bigint)), (s, x) -> {step.format(delta, patience)}).stop"
        entry = F.struct(F.col("step").cast("long").alias("step"), F.col("loss").cast("double").alias("loss"))
        return losses.groupBy("run").agg(F.array_sort(F.collect_list(entry)).alias("l")).select("run", F.expr(fold).alias("stop"))
    order = Window.partitionBy("run").orderBy("step")
    seen = losses.withColumns({"best": F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -1)), "r": F.row_number().over(order)})
    better = F.when(F.col("best").isNull() | (F.col("loss") < F.col("best")), F.col("r"))
    waited = seen.withColumn("wait", F.col("r") - F.max(better).over(order))
    return waited.groupBy("run").agg(F.min(F.when(F.col("wait") >= patience, F.col("step"))).alias("stop"))


def early_stop_stream(losses: DataFrame, patience: int, delta: float = 0.0) -> DataFrame:
    """The same fold on a stream: emits a run's stop when it comes; losses arrive in order of step within a batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, wait, done = state.get if state.exists else (float("inf"), 0, False)
        for pdf in batches:
            for step, loss in pdf.sort_values("step")[["step", "loss"]].itertuples(index=False):
                if done:
                    break
                if loss < best - delta:
                    best, wait = float(loss), 0
                else:
                    wait += 1
                    if wait >= patience:
                        done = True
                        yield pd.DataFrame({"run": [key[0]], "stop": [int(step)]})
        state.update((best, wait, done))

    return losses.groupBy("run").applyInPandasWithState(fold, "run long, stop long", "best double, wait int, done boolean", "append", GroupStateTimeout.NoTimeout)
