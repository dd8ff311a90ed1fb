"""Problem 5: matching records by nearest time.

A stateful streaming join. Both sides are buffered per entity and time slice; a left row is emitted
once the watermark has passed its tolerance horizon, with the nearest right row of its entity, and
right rows that no open left row can reach any more are evicted. Slices keep a hot entity from
ending in one task: a left row lives in one slice, a right row in each slice it can serve. Slices are
spread over lanes, so that one call of the state function works on many rows at once.

Rows that come after the watermark aren't dropped: they leave the stream marked as late and are
settled by a small join at the end (`settle_late`), so the result is that of all rows at any lateness.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mutabik.functions.scalars import micros
from mutabik.shared import shared_path

LEFT, RIGHT, END = 0, 1, 2
ROW = np.dtype([("ent", "<i8"), ("id", "<i8"), ("us", "<i8")])
OUT = "kind string, left_id bigint, ent bigint, left_us bigint, right_id bigint, right_us bigint"


def nearest(left: np.ndarray, right: np.ndarray, tolerance_us: int) -> pd.DataFrame:
    """For each left row the nearest right row of its entity; at equal distance the smaller id."""
    a = pd.DataFrame({"ent": left["ent"], "left_id": left["id"], "us": left["us"]}).sort_values("us", kind="stable")
    b = pd.DataFrame({"ent": right["ent"], "right_id": right["id"], "us": right["us"]})
    b = b.sort_values(["us", "right_id"], kind="stable").drop_duplicates(["ent", "us"]).reset_index(drop=True)
    b["k"] = np.arange(len(b))  # the merge makes floats of what may be absent; row numbers bear it, ids and times need not
    sides = [pd.merge_asof(a, b[["ent", "us", "k"]], on="us", by="ent", direction=d, tolerance=tolerance_us)["k"].fillna(-1).astype("int64").to_numpy() for d in ("backward", "forward")]
    ids, us = (np.append(b[c].to_numpy(np.int64), 0) for c in ("right_id", "us"))
    none = np.iinfo(np.int64).max
    dist = [np.where(k >= 0, np.abs(us[k] - a["us"].to_numpy()), none) for k in sides]
    later = (dist[1] < dist[0]) | ((dist[1] == dist[0]) & (ids[sides[1]] < ids[sides[0]]))
    k = np.where(later, sides[1], sides[0])
    found = lambda x: pd.array(x[k], dtype="Int64") if (k >= 0).all() else pd.array(pd.Series(x[k], dtype="Int64").where(k >= 0))
    return pd.DataFrame({"kind": "match", "left_id": a["left_id"].to_numpy(), "ent": a["ent"].to_numpy(), "left_us": a["us"].to_numpy(), "right_id": found(ids), "right_us": found(us)})


def _rows(b: bytes | None) -> np.ndarray:
    return np.frombuffer(b, ROW) if b else np.zeros(0, ROW)


def _late(rows: np.ndarray, kind: str) -> pd.DataFrame:
    left = kind == "late_left"
    none = pd.array([None] * len(rows), dtype="Int64")
    own, us = pd.array(rows["id"], dtype="Int64"), pd.array(rows["us"], dtype="Int64")
    return pd.DataFrame({"kind": kind, "left_id": own if left else none, "ent": rows["ent"], "left_us": us if left else none, "right_id": none if left else own, "right_us": none if left else us})


def _lane(tolerance_us: int):
    def step(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wm = state.getCurrentWatermarkMs() * 1000
        lbuf, rbuf = (_rows(x) for x in (state.get if state.exists else (None, None)))
        lefts, rights, end = [lbuf], [rbuf], False
        for p in parts:
            new = np.zeros(len(p), ROW)
            for c in ("ent", "id", "us"):
                new[c] = p[c].to_numpy()
            side = p["side"].to_numpy()
            end = end or bool((side == END).any())
            lefts.append(new[side == LEFT])
            rights.append(new[side == RIGHT])
        seen = len(lbuf), len(rbuf)
        lbuf, rbuf = np.concatenate(lefts), np.concatenate(rights)
        if wm > 0:  # 0: no watermark yet
            lost = (np.arange(len(lbuf)) >= seen[0]) & (lbuf["us"] + tolerance_us < wm)
            if lost.any():
                yield _late(lbuf[lost], "late_left")
                lbuf = lbuf[~lost]
            after = (np.arange(len(rbuf)) >= seen[1]) & (rbuf["us"] < wm)
            if after.any():
                yield _late(rbuf[after], "late_right")
        ready = np.ones(len(lbuf), bool) if end else (lbuf["us"] + tolerance_us < wm if wm > 0 else np.zeros(len(lbuf), bool))
        if ready.any():
            yield nearest(lbuf[ready], rbuf, tolerance_us)
        if end:
            state.remove()
            return
        rbuf = rbuf[rbuf["us"] >= wm - 2 * tolerance_us] if wm > 0 else rbuf
        state.update((lbuf[~ready].tobytes(), rbuf.tobytes()))

    return step


def _tagged(df: DataFrame, side: int, tolerance_us: int, slice_us: int, lanes: int) -> DataFrame:
    us = micros(F.col("at"))
    rows = df.where(F.col("entity").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull()).select(F.lit(side).alias("side"), F.xxhash64("entity").alias("ent"), "id", us.alias("us"), F.col("at").alias("at"))
    cell = lambda c: F.floor(c / F.lit(slice_us)).cast("bigint")
    slices = F.array(cell(F.col("us"))) if side == LEFT else F.sequence(cell(F.col("us") - tolerance_us), cell(F.col("us") + tolerance_us))
    return rows.select("side", "ent", "id", "us", "at", F.explode(slices).alias("cell")).select(
        F.pmod(F.xxhash64("ent", "cell"), F.lit(lanes)).cast("int").alias("lane"), "side", "ent", "id", "us", "at"
    )


def stream_nearest(left: DataFrame, right: DataFrame, end: DataFrame, out: str, checkpoint: str, tolerance_us: int, delay: str, slice_us: int, lanes: int) -> None:
    """Runs the stream over what the sources hold now, and appends to ``out``; resumes from ``checkpoint``.

    left and right are streams with id, entity, at; ``end`` is a stream with lane, and a row there
    closes its lane: all that is open is emitted.
    """
    closing = end.select("lane", F.lit(END).alias("side"), F.lit(0).cast("bigint").alias("ent"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("us"), F.timestamp_micros(F.lit(0)).alias("at"))
    both = _tagged(left, LEFT, tolerance_us, slice_us, lanes).unionByName(_tagged(right, RIGHT, tolerance_us, slice_us, lanes)).unionByName(closing)
    q = (
        both.withWatermark("at", delay)
        .groupBy("lane")
        .applyInPandasWithState(_lane(tolerance_us), OUT, "l binary, r binary", "append", GroupStateTimeout.NoTimeout)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def settle_late(found: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """left_id, right_id: the stream's matches, corrected by the rows that came after the watermark."""
    best = found.where("kind = 'match'")
    extra = None
    cell = lambda c: F.floor(c / F.lit(2 * tolerance_us)).cast("bigint")
    reach = lambda c: F.array_distinct(F.array(cell(F.col(c) - tolerance_us), cell(F.col(c) + tolerance_us)))
    late_r = found.where("kind = 'late_right'").select("ent", "right_id", "right_us").distinct()
    late_l = found.where("kind = 'late_left'").select("left_id", "ent", "left_us")
    if not late_r.isEmpty():
        l = best.select("left_id", "ent", "left_us", cell(F.col("left_us")).alias("cell"))  # noqa: E741
        r = late_r.withColumn("cell", F.explode(reach("right_us")))
        extra = l.join(r, ["ent", "cell"]).where(F.abs(F.col("left_us") - F.col("right_us")) <= tolerance_us).select("left_id", "ent", "left_us", "right_id", "right_us")
    if not late_l.isEmpty():
        l = late_l.withColumn("cell", cell(F.col("left_us")))  # noqa: E741
        r = right.where("entity is not null and at is not null and id is not null").select(F.xxhash64("entity").alias("ent"), F.col("id").alias("right_id"), micros(F.col("at")).alias("right_us")).withColumn("cell", F.explode(reach("right_us")))
        more = l.join(r, ["ent", "cell"]).where(F.abs(F.col("left_us") - F.col("right_us")) <= tolerance_us).select("left_id", "ent", "left_us", "right_id", "right_us")
        extra = more if extra is None else extra.unionByName(more)
    best = best.where("right_id is not null").select("left_id", "ent", "left_us", "right_id", "right_us")
    if extra is None:
        return best.select("left_id", "right_id")
    rank = F.struct(F.abs(F.col("left_us") - F.col("right_us")), F.col("right_id"))
    return best.unionByName(extra).groupBy("left_id").agg(F.min(rank).alias("r")).select("left_id", F.col("r.right_id").alias("right_id"))


def nearest_in_time(spark: SparkSession, left: tuple[str, Any], right: tuple[str, Any], tolerance_hours: float = 4, delay: str = "14 days", slice_hours: float = 24, batches: int = 5, lanes: int | None = None) -> DataFrame:
    """left_id, right_id: each left row with the nearest right row of its entity within the tolerance.

    left and right are (parquet path, function): the function turns a scan of the path, streaming or
    not, into rows with id, entity, at. A right row may serve several left rows; left rows without
    a right row in reach don't come out.

    Defined results: rows with a null id, entity or time match nothing; at equal distance the
    smaller right id wins; repeated right rows change nothing; a left row given twice comes out
    twice. Empty tables give an empty result. Late rows of any age are settled exactly.
    """
    tolerance_us, slice_us = int(tolerance_hours * 3_600_000_000), int(slice_hours * 3_600_000_000)
    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = shared_path(spark, "nearest")

    def stream(side: tuple[str, Any]) -> DataFrame:
        scan = spark.read.parquet(side[0])
        per = max(1, math.ceil(len(scan.inputFiles()) / batches))
        glob = f"{side[0][:-1]}[{side[0][-1]}]"  # a stream reads a single file only by a pattern
        return side[1](spark.readStream.schema(scan.schema).option("maxFilesPerTrigger", per).parquet(glob))

    ends = spark.range(lanes).select(F.col("id").cast("int").alias("lane"))
    ends.limit(0).write.parquet(f"{base}/end")
    run = lambda: stream_nearest(stream(left), stream(right), spark.readStream.schema("lane int").parquet(f"{base}/end"), f"{base}/out", f"{base}/checkpoint", tolerance_us, delay, slice_us, lanes)
    run()
    ends.coalesce(1).write.mode("append").parquet(f"{base}/end")
    run()
    return settle_late(spark.read.schema(OUT).parquet(f"{base}/out"), right[1](spark.read.parquet(right[0])), tolerance_us)
