"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Two pieces may not share a bin when they come from the same source or belong to
the same duplicate cluster.  Pieces are dealt over shards by a hash of their
document's id, cluster and source and of their place in it, so that a shard holds
about BINS bins whatever the size of a source or cluster, and whatever ids are
null or shared by several texts; each shard is packed on its own.  Within a shard, pieces are placed from
the longest to the shortest.  Bins are ordered by what is left in them and carry
bitmaps of their sources and clusters; the search begins at the first bin with
room and goes on to successors until the tightest bin without a conflict is
found, or opens a new one.  Successors that all have the piece's source (or all
its cluster) are passed in blocks.

Documents longer than a bin are cut into full pieces and a rest; nothing is
dropped.  Null and empty texts have length 0 and lie in no bin (bin_id null).
A null source or cluster conflicts with nothing.  Repeated rows are pieces of
their own; rows with equal lengths are placed in the order of their ids.  Extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.llm.common import WORD_SPACE, read

#: Bins in a shard, about.
BINS = 1_000
#: Bins in a block of the ordered bins, at least.
BLOCK = 64


def n_words(text: str = "text") -> Column:
    """Words of a text, null as none."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def text_cluster(text: str = "text") -> Column:
    """Documents whose texts differ in case and white space only are one duplicate cluster."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.regexp_replace(F.lower(F.btrim(F.col(text), F.lit(WORD_SPACE))), r"[\x20\x09-\x0D]+", " ")))


class Bins:
    """Bins with room, ascending by what is left in them, in blocks that know the bits all their bins have.

    A block all of whose bins have one of the bits asked for is passed as a whole,
    so the bins of one large source or cluster cost a search no walk over them.
    """

    def __init__(self):
        self.masks: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []  # (left, bin)
        self.tops: list[tuple[int, int]] = []  # the last entry of each block
        self.common: list[int] = []

    def open(self, capacity: int) -> tuple[int, int]:
        self.masks.append(0)
        return capacity, len(self.masks) - 1

    def take(self, size: int, own: int) -> tuple[int, int] | None:
        """Take out the tightest bin with room for ``size`` and none of the bits ``own``."""
        first = bisect_left(self.tops, (size, -1))
        for b in range(first, len(self.blocks)):
            if self.common[b] & own:
                continue
            block = self.blocks[b]
            for at in range(bisect_left(block, (size, -1)) if b == first else 0, len(block)):
                if not self.masks[block[at][1]] & own:
                    found = block.pop(at)
                    self.settle(b)
                    return found
        return None

    def put(self, left: int, number: int, own: int) -> None:
        """Put a bin back with the bits ``own``; a full one is closed."""
        self.masks[number] |= own
        if not left:
            return
        if not self.blocks:
            self.blocks.append([])
            self.tops.append((left, number))
            self.common.append(0)
        b = min(bisect_left(self.tops, (left, number)), len(self.blocks) - 1)
        block = self.blocks[b]
        insort(block, (left, number))
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops.insert(b, block[BLOCK - 1])
            self.common.insert(b, 0)
            self.settle(b)
            self.settle(b + 1)
        else:
            self.tops[b] = block[-1]
            self.common[b] = self.common[b] & self.masks[number] if len(block) > 1 else self.masks[number]

    def settle(self, b: int) -> None:
        """Bring the last entry and the common bits of a block up to date."""
        block = self.blocks[b]
        if block:
            self.tops[b] = block[-1]
            self.common[b] = reduce(and_, [self.masks[n] for _, n in block])
        else:
            del self.blocks[b], self.tops[b], self.common[b]


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the given order."""
    bit: dict[tuple, int] = {}
    for kind, values in (("source", sources), ("cluster", clusters)):
        for value, n in Counter(values).items():
            if value is not None and value == value and n > 1:  # a lone value cannot conflict
                bit[kind, value] = 1 << len(bit)
    bins = Bins()
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own = bit.get(("source", source), 0) | bit.get(("cluster", cluster), 0)
        left, number = bins.take(size, own) or bins.open(capacity)
        bins.put(left - size, number, own)
        out.append((number, capacity - left))
    return out


def pack(df: DataFrame, capacity: int, doc_id: str = "doc_id", length: Column | None = None, source: str = "source", cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, bin_id, offset: where each piece of each document lies."""
    length = n_words() if length is None else length
    cluster = text_cluster() if cluster is None else cluster
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.col(source).cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    total, rows = docs.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // (capacity * BINS)), -(-rows // (BINS * 20)))
    pieces = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.lit(0).cast("long"), F.col("n") - 1) / capacity))))
    pieces = pieces.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source"), F.lit(shards)).alias("shard"),
    )

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        some = group[group.length > 0]
        placed = best_fit(some.length.tolist(), some.source.where(some.source.notna(), None).tolist(), some.cluster.where(some.cluster.notna(), None).tolist(), capacity)
        shard = int(group["shard"].iloc[0])
        group = group.assign(bin_id=pd.Series([f"{shard}-{b}" for b, _ in placed], index=some.index, dtype=object), offset=pd.Series([o for _, o in placed], index=some.index, dtype="Int64"))
        return group[["doc_id", "piece", "start", "length", "bin_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("shard").applyInPandas(packed, f"doc_id {kind}, piece int, start long, length long, bin_id string, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), 2_048)
