"""Shards of near equal bytes: minimax contiguous partition of ordered atomic groups.

Equal texts hash alike, and a hash range is atomic: the texts are ordered by hash and fall into at
most ``GROUPS`` ranges, whatever the number of rows, so that the sizes of the groups are a bounded
array on the driver. The smallest capacity with which a greedy pass needs no more than the wanted
number of shards is found by binary search, and the groups are cut there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import quoted, ranked, split_count, text_of
from sluiceway.sources import lineage_cut

GROUP_BITS = 16
GROUPS = 1 << GROUP_BITS
ROW_BYTES = 16


def capacity(prefix: np.ndarray, shards: int) -> int:
    """Smallest capacity with which a greedy pass over ``prefix`` (sums with a leading 0) fits."""
    sizes = np.diff(prefix)
    low = max(int(sizes.max(initial=0)), -(-int(prefix[-1] - prefix[0]) // shards))
    high = int(prefix[-1] - prefix[0])

    def fits(cap: int) -> bool:
        at, last = 0, len(prefix) - 1
        for _ in range(shards):
            at = int(np.searchsorted(prefix, prefix[at] + cap, "right")) - 1
            if at >= last:
                return True
        return False

    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """End positions of ``shards`` contiguous runs of ``sizes`` with the smallest possible maximum.

    Among the cuts with that maximum, each end is as near to equal shares as it can be. A group
    larger than an equal share gets a shard of its own where that costs nothing, so that the rest
    is still spread evenly.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.array(_cuts(prefix, 0, len(sizes), shards), np.int64)


def _cuts(prefix: np.ndarray, lo: int, hi: int, shards: int) -> list[int]:
    if shards == 1 or lo == hi:
        return [hi] * shards
    own = prefix[lo : hi + 1]
    best = capacity(own, shards)
    giant = lo + int(np.argmax(np.diff(own)))
    if prefix[giant + 1] - prefix[giant] == best and best * shards > own[-1] - own[0]:
        left, right = prefix[lo : giant + 1], prefix[giant + 1 : hi + 1]
        choices = []
        for n in range(shards):
            m = shards - 1 - n
            if (n > 0 or left[-1] == left[0]) and (m > 0 or right[-1] == right[0]):
                worst = max(capacity(left, n) if n else 0, capacity(right, m) if m else 0)
                choices.append((worst, n))
        if choices and min(choices)[0] <= best:
            n = min(choices)[1]
            before = _cuts(prefix, lo, giant, n) if n else []
            after = _cuts(prefix, giant + 1, hi, shards - 1 - n) if shards - 1 - n else []
            ends = [*before, giant + 1, *after]
            ends[-1] = hi
            return ends
    # Earliest ends by a greedy pass from the back; what a shard reaches from its start bounds it.
    earliest = [hi] * shards
    for k in range(shards - 2, -1, -1):
        need = np.searchsorted(prefix, prefix[earliest[k + 1]] - best, "left")
        earliest[k] = max(lo, int(need))
    ends, at = [], lo
    for k in range(shards - 1):
        reach = int(np.searchsorted(prefix, prefix[at] + best, "right")) - 1
        ideal = prefix[lo] + (own[-1] - own[0]) * (k + 1) // shards
        near = int(np.searchsorted(prefix, ideal, "left"))
        if near > 0 and ideal - prefix[near - 1] < prefix[min(near, hi)] - ideal:
            near -= 1
        at = min(max(near, earliest[k], at), reach, hi)
        ends.append(at)
    return [*ends, hi]


def _sized(docs: DataFrame, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.withColumns({
        "_size": (F.octet_length(text) + ROW_BYTES).cast("long"),
        "_group": F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS).cast("int"),
    })


def shard_plan(sized: DataFrame, shards: int) -> pd.DataFrame:
    """One row per group, at most ``GROUPS``: its shard and the rows before that shard."""
    got = sized.groupBy("_group").agg(F.sum("_size").alias("size"), F.count("*").alias("rows"))
    got = got.toArrow().to_pandas().sort_values("_group", ignore_index=True)
    if got.empty:
        return pd.DataFrame({"_group": [], "shard": [], "first": []}, dtype="int64")
    ends = minimax_cuts(got["size"].to_numpy(), shards)
    shard = np.searchsorted(ends, np.arange(len(got)), "right")
    before = np.concatenate([[0], np.cumsum(got["rows"].to_numpy())])
    starts = np.concatenate([[0], ends[:-1]])
    return pd.DataFrame({"_group": got["_group"].astype("int32"), "shard": shard.astype("int32"),
                         "first": before[starts[shard]].astype("int64")})


def _planned(sized: DataFrame, shards: int) -> DataFrame:
    plan = shard_plan(sized, shards)
    spark = sized.sparkSession
    rows = list(plan.itertuples(index=False, name=None))
    small = spark.createDataFrame(
        [(int(g), int(s), int(f)) for g, s, f in rows], "_group int, _shard int, _first long"
    )
    return sized.join(F.broadcast(small), "_group")  # at most GROUPS rows


def assign_shards(docs: DataFrame, shards: int, text_col: str = "text") -> DataFrame:
    """Documents with the columns ``shard`` and ``shard_bytes``; rows do not move.

    A column of the input with one of these names is replaced.
    """
    kept = [quoted(c) for c in docs.columns if c not in ("shard", "shard_bytes")]
    whole = docs.select(F.struct(*kept).alias("_doc"), text_of(text_col).alias("text"))
    return _planned(_sized(whole, "text"), shards).select(
        "_doc.*", F.col("_shard").alias("shard"), F.col("_size").alias("shard_bytes")
    )


def shard_slots(docs: DataFrame, shards: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot (gapless from 0 in its shard).

    Null texts have no bytes. Equal texts share a shard. Rows that agree in id and text take
    neighbouring slots. An empty table gives no rows; with fewer groups than shards some stay empty.
    """
    narrow = lineage_cut(_sized(docs.select(
        quoted(id_col).cast("long").alias("id"), text_of(text_col).alias("text")
    ), "text").select("id", "_group", "_size", F.crc32(F.col("text").cast("binary")).alias("crc")))
    order = ["_group", "id", "crc", "_size"]
    placed = ranked(_planned(narrow, shards), order, split_count(narrow, 1_000_000, narrow.count()),
                    "_rank")
    return placed.select(
        "id", F.col("_size").alias("size"), F.col("crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_first")).alias("slot"),
    )
