"""Passes as a stream: the step of each pixel from one pass to the next, as passes arrive in files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import stats
from ..storage import drop_table, materialize, shared_dir

STEPS = "pass_idx int, row int, col int, step_db int"


def steps(stream: DataFrame, tile: int = 64) -> DataFrame:
    """STEPS of a stream of obs (pass_idx, row, col, vv, vh) whose passes arrive in order.

    State is kept by tile: for each pixel seen its last pass and summed intensity, as arrays. A pass that is missing,
    or comes late, gives no step.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState):
        held = pd.DataFrame(dict(zip(("row", "col", "pass_idx", "total"), state.get if state.exists else ([], [], [], []), strict=True)))
        new = pd.concat(list(parts))[["row", "col", "pass_idx", "total"]]
        late = new.merge(held[["row", "col", "pass_idx"]].rename(columns={"pass_idx": "last"}), on=["row", "col"], how="left") if len(held) else new.assign(last=float("nan"))
        new = late[late["last"].isna() | (late["pass_idx"] > late["last"])].drop(columns="last")
        rows = pd.concat([held, new]) if len(held) else new
        rows = rows.sort_values(["row", "col", "pass_idx"], kind="stable").drop_duplicates(["row", "col", "pass_idx"]).astype({"row": "int32", "col": "int32", "pass_idx": "int32", "total": "float64"})
        same = (rows["row"] == rows["row"].shift()) & (rows["col"] == rows["col"].shift()) & (rows["pass_idx"] == rows["pass_idx"].shift() + 1)
        out = rows.assign(was=rows["total"].shift()).rename(columns={"total": "now"})[same]
        last = rows.drop_duplicates(["row", "col"], keep="last")
        state.update(tuple(last[c].tolist() for c in ("row", "col", "pass_idx", "total")))
        yield out.assign(pass_idx=(out["pass_idx"] - 1).astype("int32"))[["pass_idx", "row", "col", "was", "now"]]

    summed = stream.select("pass_idx", "row", "col", (F.col("vv") + F.col("vh")).alias("total"), F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col"))
    raw = summed.groupBy("tile_row", "tile_col").applyInPandasWithState(run, "pass_idx int, row int, col int, was double, now double", "row array<int>, col array<int>, last array<int>, value array<double>", "append", GroupStateTimeout.NoTimeout)
    return raw.select("pass_idx", "row", "col", F.rint(stats.decibels(F.col("was"), F.col("now")) * 100).cast("int").alias("step_db"))


def replay(obs: DataFrame, n_passes: int) -> DataFrame:
    """Write obs pass by pass as files, stream them in that order, and return the sink's table.

    obs is worked out once. A pass is written by several tasks; files of a pass are older than those of the next, and a
    batch takes as many as a pass has at most, so that no pixel's passes change places, wherever a batch ends."""
    spark = obs.sparkSession
    root = f"{shared_dir(spark)}/chronoscape/stream-{uuid.uuid4().hex}"
    worked_out = materialize(obs, "passes")
    files = max(1, min(spark.sparkContext.defaultParallelism, worked_out.rdd.getNumPartitions()))
    for i in range(n_passes):
        worked_out.where(F.col("pass_idx") == i).coalesce(files).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    query = steps(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    drop_table(worked_out)
    return spark.read.schema(STEPS).parquet(f"{root}/out")
