"""Trie of the common beginnings of conversations, with count-min screening of prefix digests.

A prefix is known by 128 bits, the exclusive or of one digest for each of its
turns and places, so texts are read once and never shuffled.  A count-min sketch
of all prefixes, with counters that stop at two, is summed over the cluster and
broadcast: an estimate of one proves that one conversation alone starts so.  Such
a prefix needs no grouping; its node is written from its own row, and so is all
that follows it.  Only prefixes that may be shared are shuffled and grouped
exactly, so the sketch decides the cost and never the result.

Sums over subtrees need no walk by depth.  A node's smallest member is the
smallest of every deeper node it runs through, so it carries a node's value; the
sum over a subtree is that of what its members carry, less what its own smallest
member carries above it.

Bounds: the sketch grows with the input to WIDEST cells in each of its two rows
(32 MB); beyond that more prefixes count as possibly shared.  Long conversations
are numbered and summed in parts (ranges of the ordered turns, blocks of BLOCK
places).  Ids that end in one node are sorted in ranges and packed; one task
hashes the packed text of a node in order without holding it, as a single hash
has to.

Turns of null conversations are left out.  Turns of one number, and those without
one (they come first), are ordered by the digest of role and text, so repeated
rows are turns of their own.  Null role or text is empty.  An empty table has no
conversations and no nodes, not even a root.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.common import read, scratch_folder, write_table

#: Places of a conversation that one task sums up at once.
BLOCK = 1_024
#: Cells in each of the sketch's two rows, at most; there are about CELLS for each prefix below that.
WIDEST, CELLS = 1 << 27, 8
#: Cells of the sketch that are summed together.
PART = 1 << 20
NODE = ["depth", "x", "y"]
WORD = r"[^ \t\n\x0B\f\r]+"


def numbered(conversations: DataFrame, folder: str | None = None) -> DataFrame:
    """conv_id, position (from 1), n_turns, a, b (digest of role and text), words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = ["turn", "a", "b"]
    placed = write_table(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns", folder=folder)
    whole = Window.partitionBy("conv_id")
    before = F.sum("count").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("count").over(whole).alias("n_turns"))
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")
    return placed.withColumn("at", at).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at")).alias("position"), "n_turns", "a", "b", "words")


def running(rows: DataFrame, key: str, at: str, names: list[str], total: Callable, add: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with each of ``names`` summed over the rows of one ``key`` up to the own ``at``, as to_NAME.

    Summed in blocks of ``at`` first, so a key of many rows is many tasks.
    """
    rows = rows.withColumn("__block", F.floor(F.col(at) / BLOCK))
    blocks = rows.groupBy(key, "__block").agg(*(total(n).alias(n) for n in names))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(key, "__block", *(total(n).over(before).alias(f"__{n}") for n in names)).where(F.col(f"__{names[0]}").isNotNull())
    here = Window.partitionBy(key, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"to_{n}": total(n).over(here) for n in names}).join(carried, [key, "__block"], "left")
    return rows.withColumns({f"to_{n}": add(F.col(f"to_{n}"), F.coalesce(f"__{n}", F.lit(0))) for n in names}).drop("__block", *(f"__{n}" for n in names))


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation and depth from 0 on: conv_id, depth, x, y (digest), px, py (of the parent), words, last."""
    hashed = turns.withColumns({"x": F.xxhash64(F.lit(3), "position", "a", "b"), "y": F.xxhash64(F.lit(4), "b", "a", "position")})
    rows = running(hashed, "conv_id", "position", ["x", "y"], F.bit_xor, xor).select(
        "conv_id", F.col("position").alias("depth"), F.col("to_x").alias("x"), F.col("to_y").alias("y"), xor(F.col("to_x"), F.col("x")).alias("px"), xor(F.col("to_y"), F.col("y")).alias("py"), "words", (F.col("position") == F.col("n_turns")).alias("last")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return rows.union(conversations.select("conv_id", zero, zero, zero, none, none, zero, F.col("n_turns") == 0))


def _cells(batch: pa.RecordBatch, names: tuple[str, str], width: int) -> list[np.ndarray]:
    """The cell of each row in both rows of the sketch, which stand one behind the other."""
    return [(batch.column(n).fill_null(0).to_numpy() & (width - 1)) + i * width for i, n in enumerate(names)]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Packed bits of the cells that two prefixes or more share: 2 * ``width`` bits, whatever the rows."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            cells = np.repeat(cells, np.minimum(counts, 2))
            part = cells // PART
            cuts = np.flatnonzero(np.diff(part)) + 1
            each = [p.astype(np.uint32).tobytes() for p in np.split(cells % PART, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(part[np.r_[0, cuts]], pa.int32()), pa.array(each, pa.binary())], ["part", "cells"])

        for batch in source:
            held += _cells(batch, ("x", "y"), width)
            if sum(map(len, held)) >= 4 * PART:
                yield flush()
        if any(map(len, held)):
            yield flush()

    def merge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in source:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                counts = seen.setdefault(part, np.zeros(PART, np.uint8))
                at, n = np.unique(np.frombuffer(cells, np.uint32), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 2)
        for part, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(counts == 2).tobytes()], pa.binary())], ["part", "cells"])

    schema = "part int, cells binary"
    bits = np.zeros(max(1, -(-2 * width // PART)) * PART // 8, np.uint8)
    for r in rows.select("x", "y").mapInArrow(count, schema).repartition("part").mapInArrow(merge, schema).toLocalIterator():
        bits[r.part * PART // 8 : (r.part + 1) * PART // 8] = np.frombuffer(r.cells, np.uint8)
    return bits


def screened(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with shared and parent_shared: false where the sketch proves that the prefix is one conversation's."""
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))  # 32 MB at most

    def screen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = bits.value
        for batch in source:
            out = []
            for names in (("x", "y"), ("px", "py")):
                hit = [(twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 for c in _cells(batch, names, width)]
                out.append((hit[0] & hit[1]).astype(bool) & ~batch.column(names[0]).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], [*batch.schema.names, "shared", "parent_shared"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(screen, f"{types}, shared boolean, parent_shared boolean")


def ends(members: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of conv_ids, one behind the other in ascending order, joined by commas."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = np.stack([batch.column(n).to_numpy() for n in NODE])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1
            ids = batch.column("conv_id").cast(pa.string()).to_pylist()
            starts = np.r_[0, cuts]
            texts = [",".join(ids[a:b]) for a, b in zip(starts.tolist(), [*cuts.tolist(), len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(starts)) for n in (*NODE, "conv_id")), pa.array(texts)], [*NODE, "conv_id", "ids"])

    def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        one = lambda: pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in source:
            for *now, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids")), strict=True):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    yield one()
                key, state = now, hashlib.sha256(ids.encode())
        if key:
            yield one()

    node = "depth long, x long, y long"
    order = [*NODE, "conv_id"]
    packed = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"{node}, conv_id long, ids string")
    return packed.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, f"{node}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of all beginnings of ``conversations`` (conv_id, n_turns, each once) with ``turns`` as numbered() gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words that members need not repeat, over the subtree)
    and ends_sha256 (of the ids of members that end here).
    """
    spark = turns.sparkSession
    with scratch_folder(spark, "prefixes") as folder:
        rows = write_table(prefixes(turns, conversations), "rows", folder=folder)
        width = 1 << min(max(16, ceil(log2(CELLS * max(1, rows.count())))), WIDEST.bit_length() - 1)
        rows = write_table(screened(rows, width), "trie-rows")
    shared, alone = rows.where("shared"), rows.where("NOT shared")
    groups = write_table(
        shared.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py")
        ).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")),
        "trie-groups",
    )
    # What each conversation carries: the value of nodes whose smallest member it is, and whether it is a leaf's.
    carries = groups.select("conv_id", "saved", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaf"))
    carries = carries.union(alone.where("last").select("conv_id", F.lit(0), F.lit(1))).groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.max("leaf").alias("leaf"))
    tops = alone.where("parent_shared")
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    child = [*up, F.lit(0).alias("saved"), F.lit(0).alias("leaf"), F.lit(1).alias("child")]
    parts = shared.join(carries, "conv_id", "left").select(*NODE, F.coalesce("saved", F.lit(0)), F.coalesce("leaf", F.lit(0)), F.lit(0))
    parts = groups.where("depth > 0").select(*child).union(tops.select(*child)).union(parts)
    sums = parts.groupBy(*NODE).agg(F.sum("saved").alias("carried"), F.sum("leaf").alias("n_leaves"), F.sum("child").alias("n_children"))

    root = groups.where("depth = 0").select("conv_id").first()  # one row: all conversations start with it
    root = F.lit(root.conv_id if root else None).cast("long")
    above = groups.select(*(F.col(n).alias(f"p_{n}") for n in NODE), F.col("conv_id").alias("parent_conv_id"))

    def with_parent(nodes: DataFrame) -> DataFrame:
        """parent_conv_id; a parent that isn't grouped is the same conversation's."""
        deep = nodes.where("depth > 1").join(above, (F.col("depth") - 1 == F.col("p_depth")) & (F.col("px") == F.col("p_x")) & (F.col("py") == F.col("p_y")), "left")
        deep = deep.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id")).drop("p_depth", "p_x", "p_y")
        return nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.coalesce(root, "conv_id"))).unionByName(deep)

    empty, one = F.sha2(F.lit("").cast("binary"), 256), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    exact = running(groups, "conv_id", "depth", ["saved"], F.sum, lambda a, b: a + b).join(sums, NODE).join(ends(shared.where("last")), NODE, "left")
    exact = with_parent(exact).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("carried") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )
    whole = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    single = [whole(1).alias("n_convs"), whole(~F.col("last")).alias("n_children"), whole(1).alias("n_leaves"), whole(0).alias("saved_tokens"), F.when(F.col("last"), one).otherwise(empty).alias("ends_sha256")]
    own = F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    return (
        exact.unionByName(with_parent(tops).select("conv_id", "depth", "parent_conv_id", *single))
        .unionByName(alone.where("NOT parent_shared").select("conv_id", "depth", own, *single))
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) of the contract: each begins with the first turns of another (ids that are multiples of 20)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = turns.where("position <= 3").groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("position", "a", "b", "words"))).alias("head"))
    plan = turns.where("position = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), F.col("n_turns").alias("own")).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast("array<struct<position:bigint,a:bigint,b:bigint,words:bigint>>")).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int")))
    plan = plan.withColumn("head", head).withColumn("taken", F.size("head").cast("long"))
    plan = plan.withColumn("n_turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    first = plan.select("conv_id", "n_turns", F.explode("head").alias("t")).select("conv_id", "t.position", "n_turns", "t.a", "t.b", "t.words")
    later = turns.drop("n_turns").where(F.col("position") > h).join(plan.select("conv_id", "h", "taken", "n_turns"), "conv_id")
    return first.union(later.select("conv_id", F.col("position") - F.col("h") + F.col("taken"), "n_turns", "a", "b", "words")), plan.select("conv_id", "n_turns")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_folder(spark, "turns") as folder:
        turns = write_table(numbered(read(spark, sf_dir, "conversations"), folder), "numbered", folder=folder)
        return prefix_trie(*rebuilt(turns))


TRIE_SQL = r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(t ORDER BY i) AS turns FROM turns GROUP BY conv_id),
steps AS (SELECT conv_id, turns, flatten([[ascii(d), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(conv_id::VARCHAR, '')]) AS s FROM whole),
keyed AS (SELECT conv_id, turns, (4294967295 - list_reduce(s, lambda c, v: CASE WHEN v >= 0 THEN xor(c, v::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295::BIGINT)) % 4 AS h FROM steps),
rebuilt AS (SELECT k.conv_id, list_concat(coalesce(b.turns[1:k.h], []), k.turns[k.h + 1:]) AS turns FROM keyed k LEFT JOIN whole b ON b.conv_id = k.conv_id - k.conv_id % 20),
members AS (SELECT conv_id, turns[1:d] AS path, d, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^ \t\n\x0B\f\r]+')) END AS saved FROM members GROUP BY path, d),
children AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT path[1:e] AS path, e AS d, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT n.path, n.saved, c.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS e FROM nodes n LEFT JOIN children c ON c.path = n.path AND c.d = n.d) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.path = n.path AND b.d = n.d LEFT JOIN children c ON c.path = n.path AND c.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
