"""Problem 7: filling fixed-capacity containers with items.

Sum-of-squares online packing. A level array holds how many open containers there are at each fill;
an item goes where the sum of the squared counts becomes smallest, into an open container or a new
one. Items are spread over lanes of bounded length by hash, each lane packs on its own, and what the
lanes leave unfilled is packed once more, whole containers being the items then.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutabik.shared import shared_table

#: Pack sizes are a short list of settings; more are refused.
MOST_PACKS = 1000
#: Items of a lane, about.
LANE_ITEMS = 40_000


class LevelArray:
    """One lane's open containers by fill."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.fill: list[int] = []

    def place(self, size: int) -> int:
        """The container of an item; 0 < size <= capacity."""
        b, n = self.capacity, self.count
        if size == b:
            self.fill.append(b)
            return len(self.fill) - 1
        here = n[: b - size + 1]
        # Half the change of the sum of squares, for each level h that the item would leave.
        score = np.where(here > 0, n[size:] - here + 1.0, np.inf)
        score[b - size] -= 0.5 if here[b - size] else 0.0
        score[0] = n[size] + 0.5
        h = b - size - int(np.argmin(score[::-1]))  # among equals the fullest
        if h:
            k = self.open[h].pop()
            n[h] -= 1
        else:
            k = len(self.fill)
            self.fill.append(0)
        self.fill[k] += size
        if h + size < b:
            self.open[h + size].append(k)
            n[h + size] += 1
        return k


def _lanes(items: DataFrame, lane_items: int) -> DataFrame:
    """(pack_name, capacity, item, tokens) with lane and slot: the container within the lane."""
    n = items.count()
    lanes = max(1, -(-n // lane_items))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        me = TaskContext.get().partitionId()
        arrays: dict[str, LevelArray] = {}
        for p in parts:
            slot = np.empty(len(p), np.int64)
            for i, (name, capacity, size) in enumerate(zip(p["pack_name"], p["capacity"], p["tokens"])):
                if name not in arrays:
                    arrays[name] = LevelArray(int(capacity))
                slot[i] = arrays[name].place(int(size))
            yield p.assign(lane=me, slot=slot)

    spread = items.withColumn("_h", F.xxhash64("pack_name", "item")).repartition(lanes, "_h").sortWithinPartitions("_h", "item").drop("_h")
    return spread.mapInPandas(pack, "pack_name string, capacity int, item string, tokens bigint, lane int, slot bigint")


def pack_items(sizes: DataFrame, packs: DataFrame, lane_items: int = LANE_ITEMS) -> DataFrame:
    """pack_name, doc_id, piece, tokens, container: where each item or piece of each pack goes.

    sizes: doc_id, tokens. packs: pack_name, capacity_tokens. An item larger than the capacity is cut
    into pieces of the capacity and one for the rest; all others stay whole. container is unique
    within its pack.

    Defined results: an item without tokens takes no room and has container null (piece 0); a null
    doc_id is packed like any other; an item given twice is packed twice; a pack without a name or
    with a capacity below 1 or null is ignored; empty tables give an empty result.
    """
    packs = packs.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).dropDuplicates(["pack_name"])
    ids = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    sizes_of = [(r["pack_name"], r["capacity"]) for r in packs.orderBy("pack_name").limit(MOST_PACKS + 1).collect()]
    if len(sizes_of) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} pack sizes")
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("int").alias("capacity")) for n, c in sizes_of]) if sizes_of else F.array().cast("array<struct<pack_name:string,capacity:int>>")
    both = ids.select("doc_id", "tokens", F.explode(each).alias("_p")).select("doc_id", "tokens", "_p.*")
    last = F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1
    cut = both.withColumn("piece", F.explode(F.when(F.col("tokens") > 0, F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))))
    piece = F.least(F.col("capacity").cast("bigint"), F.col("tokens") - F.col("piece").cast("bigint") * F.col("capacity"))
    pieces = cut.select("pack_name", "capacity", "doc_id", "piece", piece.alias("tokens"))
    named = pieces.where("tokens > 0").withColumn("item", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string")))
    first = shared_table(_lanes(named.select("pack_name", "capacity", "item", "tokens"), lane_items), "packed")
    bins = first.groupBy("pack_name", "capacity", "lane", "slot").agg(F.sum("tokens").alias("tokens"))
    bins = bins.withColumn("item", F.concat_ws("/", F.col("lane").cast("string"), F.col("slot").cast("string")))
    rest = _lanes(bins.where("tokens < capacity").select("pack_name", "capacity", "item", "tokens"), lane_items)
    moved = rest.select("pack_name", "item", F.concat(F.lit("r"), F.col("lane").cast("string"), F.lit("/"), F.col("slot").cast("string")).alias("to"))
    placed = first.withColumn("bin", F.concat_ws("/", F.col("lane").cast("string"), F.col("slot").cast("string")))
    out = placed.join(moved.withColumnsRenamed({"pack_name": "_p", "item": "_i"}), (F.col("pack_name") == F.col("_p")) & (F.col("bin") == F.col("_i")), "left")
    parts = F.split("item", ":")
    full = out.select(
        "pack_name", F.when(parts[0] != "null", parts[0].cast("bigint")).alias("doc_id"), parts[1].cast("int").alias("piece"), "tokens", F.coalesce("to", "bin").alias("container")
    )
    none = pieces.where("tokens = 0").select("pack_name", F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "tokens", F.lit(None).cast("string").alias("container"))
    return full.unionByName(none)


def container_fill(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, container, items, fill, unused of each container."""
    c = packs.select(F.col("pack_name").alias("_p"), F.col("capacity_tokens").cast("bigint").alias("_c"))
    f = packed.where("container is not null").groupBy("pack_name", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("fill"))
    return f.join(c, F.col("pack_name") == F.col("_p")).select("pack_name", "container", "items", "fill", (F.col("_c") - F.col("fill")).alias("unused"))
