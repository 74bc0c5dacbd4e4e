"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set is that of its distinct word n-grams as 64-bit hashes.  Equal
sets are one.  Two sets can be as similar as asked only if they share several
members of their prefixes (the first members in one global order, as many as the
sets may differ by and as many more as they must share).  A tile holds the sets
with one common prefix member whose sizes have one band, a power of two; sets
that may be similar to larger ones are guests in the next band, where guests
don't meet each other.  A set in fewer tiles of a band than a similar one would
share with it leaves them all, and of those it must share it may leave half, the
largest.  Tiles too large for one task are dealt as pairs of blocks.  In a tile,
parity bitmaps of the sets bound every overlap from above: each bit in which two
bitmaps differ stands for at least one element that the sets don't share.  Pairs
that pass are intersected exactly as sorted arrays.  Bitmaps travel to the tiles;
texts are read again and travel only for pairs that bitmaps don't rule out.

Only components are asked for, so pairs within one component need no test.  Two
rounds test one pair a set (a smallest set of about its size that shares most
tiles, then its nearest partner outside its component); a last round tests all
pairs that still span components.  No link between different components is
lost, and a group of m copies costs about m tests instead of m * m.

The global order puts the HOT commonest n-grams of a sample of at most SAMPLE
documents last.  Any order gives the same result; this one keeps common passages
out of the prefixes.

Null and empty texts have empty sets and are linked with nothing.  Rows with a
null id have a null component.  Repeated rows are one document.  An id that
comes with several texts has several sets, all of one component.  Ties don't
arise: a component's id is the smallest of its documents.  Extra columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.common import batches, lists, read, scratch_folder, write_table
from chalkline.llm.components import components

#: N-grams put last in the order, from a sample of as many documents.
HOT, SAMPLE = 131_072, 1 << 20
#: Sets of a tile (or of each side of a pair of blocks) in one task; partners of a set intersected in one task.
TILE, PARTNERS = 1_024, 128
#: Words of bitmaps compared at once.
AT_ONCE = 1 << 21
#: Bits of the filter of ids whose texts are compared (16 MB).
FILTER = 1 << 27
#: Prefixes are longer by this fraction, so that as many members must be shared.
SHARE = 4
REMEMBERED = 500_000


@dataclass(frozen=True)
class Similarity:
    """``percent`` * union size <= 100 * intersection size, over n-grams of ``words`` words."""

    words: int = 5
    percent: int = 80

    def overlap(self, n: int) -> int:
        """The smallest intersection, and the smallest set, that is similar to a set of n."""
        return -(-self.percent * n // 100)

    def shared(self, n: int) -> int:
        """Prefix members that two similar sets share, the smaller of which has n."""
        return min(1 + (n - self.overlap(n) + 1) // SHARE, self.overlap(n))

    def prefix(self, n: int) -> int:
        return n - self.overlap(n) + self.shared(n)

    def needed(self, n: str) -> Column:
        """``shared`` of the smallest set that is similar to one of size ``n`` (a column)."""
        least = f"(({self.percent} * {n} + 99) div 100)"
        overlap = f"(({self.percent} * {least} + 99) div 100)"
        return F.expr(f"least(1 + ({least} - {overlap} + 1) div {SHARE}, {overlap})")

    def difference(self, both: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of two similar sets whose sizes add up to ``both``."""
        return both - 2 * -(-self.percent * both // (100 + self.percent))

    def bits(self, n: int) -> int:
        """Bits of a bitmap: four to eight times the difference that may occur, a power of two."""
        return 1 << max(64, 4 * n * (100 - self.percent) // self.percent).bit_length()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of word hashes."""
    mixed = np.full(max(0, len(h) - k + 1) if k else 0, k, np.uint64)
    for i in range(k):
        mixed = (mixed ^ h[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the n-grams of each text; the whole sequence where it is shorter."""
    tokens = [(x or "").encode().lower().split() for x in texts]  # bytes: A-Z only, ASCII white space
    sizes = list(map(len, tokens))
    h = np.fromiter(map(word_hashes().__getitem__, chain.from_iterable(tokens)), np.uint64, sum(sizes))
    mixed = ngrams(h, words)
    out, at = [], 0
    for n in sizes:
        out.append(np.unique(mixed[at : at + n - words + 1] if n >= words else ngrams(h[at : at + n], n)))
        at += n
    return out


def bitmap(members: np.ndarray, bits: int) -> bytes:
    """Parity of the number of members in each of ``bits`` cells."""
    cells = (members * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hot_members(docs: DataFrame, s: Similarity) -> np.ndarray:
    """The commonest n-grams of a sixteenth of the documents, or SAMPLE of them: at most HOT, each in eight of them or more."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 1 << 20):
            member, n = np.unique(np.concatenate(shingles(batch.column("text").to_pylist(), s.words)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(n)], ["member", "n"])

    one_in = max(16, -(-docs.count() // SAMPLE))
    counts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "member long, n long").groupBy("member").agg(F.sum("n").alias("n"))
    rows = counts.where("n >= 8").orderBy(F.desc("n"), "member").limit(HOT).select("member").collect()
    return np.sort(np.array([r.member for r in rows], np.int64).view(np.uint64))


def set_rows(docs: DataFrame, s: Similarity, hot: np.ndarray) -> DataFrame:
    """doc_id, n, high and low (128-bit digest of the set), prefix array<long>."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(source, "text"):
            n, digests, prefixes = [], [], []
            for members in shingles(batch.column("text").to_pylist(), s.words):
                n.append(len(members))
                digests.append(xxhash.xxh3_128_digest(members.tobytes()))
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, members), len(hot) - 1)] == members
                    members_in_order = np.concatenate([members[~is_hot], members[is_hot]])
                else:
                    members_in_order = members
                prefixes.append(members_in_order[: s.prefix(len(members)) if len(members) else 0].view(np.int64))
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists(np.concatenate(prefixes), [len(p) for p in prefixes], pa.int64())],
                ["doc_id", "n", "high", "low", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, high long, low long, prefix array<long>")


def tile_rows(unique: DataFrame, s: Similarity) -> DataFrame:
    """(tile, guest, key, n): sets in a tile with others, not all of them guests.

    A tile's number is a hash of the n-gram and the band: tiles that share one are compared as one.
    """
    own = F.length(F.bin("n"))
    bands = F.when(F.expr(f"100 * n >= {s.percent} * shiftleft(1L, length(bin(n)))"), F.array(own, own + 1)).otherwise(F.array(own))
    members = unique.select("key", "n", own.alias("own"), bands.alias("bands"), F.explode("prefix").alias("token"))
    rows = members.select("token", F.explode("bands").alias("band"), "own", "key", "n").select(F.xxhash64("token", "band").alias("tile"), (F.col("band") > F.col("own")).alias("guest"), "key", F.col("n").cast("int").alias("n"))
    tile = Window.partitionBy("tile")  # most rows are alone in theirs: they are shuffled once, with no second copy for a join
    met = rows.withColumns({"size": F.count("*").over(tile), "at_home": F.bool_or(~F.col("guest")).over(tile)})
    return met.where("size > 1 AND at_home").drop("size", "at_home")


def frequent(tiles: DataFrame, s: Similarity) -> DataFrame:
    """Rows of the sets that lie in as many tiles of a band as a similar pair shares."""
    return tiles.withColumn("tiles", F.count("*").over(Window.partitionBy("key", "guest"))).where(F.col("tiles") >= s.needed("n")).drop("tiles")


def first_partners(tiles: DataFrame, s: Similarity) -> DataFrame:
    """For each set the smallest of about its size that it meets in most tiles: (a, b)."""
    level = F.floor(F.log("n") / float(np.log(100 / s.percent)))  # sets of a level fit each other, but for rounding
    rows = tiles.where("NOT guest").select("tile", level.alias("level"), "key", "n")
    least = rows.groupBy("tile", "level").agg(F.min(F.struct("n", "key")).alias("least"))
    stars = rows.join(least.select("tile", "level", F.col("least.key").alias("a")), ["tile", "level"]).where("a <> key")
    return stars.groupBy("a", F.col("key").alias("b")).count().groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")


def spanning(tiles: DataFrame) -> DataFrame:
    """The rows of tiles with sets of several components, and the ``size`` of their tile."""
    tile = Window.partitionBy("tile")
    spans = tiles.withColumns({"low": F.min("component").over(tile), "high": F.max("component").over(tile), "size": F.count("*").over(tile)})
    return spans.where("low < high").drop("low", "high")


def open_tiles(tiles: DataFrame, found: DataFrame, sets: DataFrame, s: Similarity, folder: str) -> DataFrame:
    """Tiles that span components, with components and bitmaps, cut into pairs of blocks where they are large.

    Similar sets of two components share only such tiles, so sets in too few of
    them are left out first.  Two that must share c tiles still share one when
    each leaves (c - 1) / 2, so each leaves its largest.
    """
    known = tiles.join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    known = frequent(spanning(known), s)
    largest = Window.partitionBy("key", "guest").orderBy(F.desc("size"), "tile")
    known = known.withColumn("nth", F.row_number().over(largest)).where(F.col("nth") > F.floor((s.needed("n") - 1) / 2)).drop("nth", "size")
    known = write_table(known, "open", folder=folder)
    blocks = (F.col("size") / TILE).cast("int") + 1
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = spanning(known).withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tile", F.least("own", "partner").alias("block"), F.greatest("own", "partner").alias("other"), (F.col("own") > F.col("partner")).alias("second"), "guest", "key", "n", "component")
    return rows.join(sets.select("key", "bits"), "key")


class Signatures:
    """Bitmaps of rows as matrices of 64-bit words, by width."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.made = maps, {}
        self.words = np.fromiter(map(len, maps), np.int64, len(maps)) // 8

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of ``width`` words, the wider ones folded, and the place of each row among them."""
        if width not in self.made:
            at, parts, n = np.zeros(len(self.maps), np.int64), [], 0
            for wide in np.unique(self.words[self.words >= width]).tolist():
                rows = np.flatnonzero(self.words == wide)
                matrix = np.frombuffer(b"".join([self.maps[i] for i in rows]), np.uint64).reshape(len(rows), wide)
                while matrix.shape[1] > width:
                    half = matrix.shape[1] // 2
                    matrix = matrix[:, :half] ^ matrix[:, half:]
                at[rows] = np.arange(n, n + len(rows))
                parts.append(matrix)
                n += len(rows)
            self.made[width] = np.concatenate(parts), at
        return self.made[width]

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of rows i and j differ."""
        width = np.minimum(self.words[i], self.words[j])
        out = np.zeros(len(i), np.int64)
        for w in np.unique(width).tolist():
            matrix, at = self.of(w)
            pairs = np.flatnonzero(width == w)
            for part in np.array_split(pairs, max(1, len(pairs) * w // AT_ONCE)):
                out[part] = np.bitwise_count(matrix[at[i[part]]] ^ matrix[at[j[part]]]).sum(1, dtype=np.int64)
        return out


def fitting_pairs(tiles: DataFrame, s: Similarity, every: bool) -> DataFrame:
    """(a, b, distance) of different components in a tile that the bitmaps don't rule out: all, or each set's nearest."""
    tile = ["tile", "block", "other"]

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of whole tiles, all at once."""
        group = np.cumsum(tile_starts(rows)) - 1
        n, key, component = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "key", "component"))
        order = np.lexsort((key, n, group))
        group, n, key, component = group[order], n[order], key[order], component[order]
        second, guest = (rows.column(c).to_numpy()[order] for c in ("second", "guest"))
        across = (rows.column("block").to_numpy() != rows.column("other").to_numpy())[order]
        raw = rows.column("bits").to_pylist()
        signatures = Signatures([raw[i] for i in order])
        # The partners of a row are those behind it in its tile, up to the largest fitting size.
        reach = 100 * n // s.percent
        step = int(reach.max()) + 1
        partners = np.searchsorted(group * step + n, group * step + reach, "right") - np.arange(len(n)) - 1
        ends = np.cumsum(partners)
        for rows_ in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
            some = partners[rows_]
            i = np.repeat(rows_, some)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
            may = (component[i] != component[j]) & ~(guest[i] & guest[j]) & ((second[i] != second[j]) | ~across[i])
            i, j = i[may], j[may]
            distance = signatures.distances(i, j)
            may = distance <= s.difference(n[i] + n[j])
            a, b, distance = key[i[may]], key[j[may]], distance[may]
            best = np.lexsort((a, b)) if every else np.lexsort((a, distance, b))
            a, b, distance = a[best], b[best], distance[best]
            first = np.diff(b, prepend=-1) != 0
            if every:  # a pair that several tiles of a batch show is one
                first |= np.diff(a, prepend=-1) != 0
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(distance[first])], ["a", "b", "distance"])

    def tile_starts(rows: pa.Table) -> np.ndarray:
        """Which rows begin a tile."""
        names = [rows.column(c).to_numpy() for c in tile]
        return np.any([np.diff(x, prepend=x[0] - 1) != 0 for x in names], axis=0)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the tile that may go on in the next batch
        for batch in source:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = int(np.flatnonzero(tile_starts(table))[-1])
            if last:
                yield from compare(table.slice(0, last).combine_chunks())
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    pairs = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "a long, b long, distance long")
    if every:
        return pairs.select("a", "b").distinct()
    return pairs.groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a")).select("a", "b")


def id_bits(column: str, size: int) -> list[Column]:
    """The places of an id among ``size`` bits, a power of two."""
    return [F.xxhash64(column, F.lit(i)).bitwiseAND(size - 1) for i in range(2)]


def id_filter(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the ids of a column, some 16 bits an id and FILTER bits at most: a fuller one lets more other ids pass."""
    size = min(FILTER, 1 << max(6, (16 * df.count()).bit_length()))
    places = df.select(F.explode(F.array(*id_bits(column, size))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()  # FILTER / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def wanted_texts(docs: DataFrame, wanted: DataFrame, s: Similarity, make: Callable[[str, np.ndarray], bytes]) -> DataFrame:
    """first, high, low, made: ``make(text, members)`` of each wanted set (first, high, low), once.

    Most texts whose id no wanted set has are left out by a filter of bounded size;
    the join by id and digest leaves out the others, also other texts of an id.
    """
    wanted = wanted.select("first", "high", "low").distinct()
    wanted_ids = id_filter(wanted, "first")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(source, "text"):
            places = [batch.column(c).to_numpy() for c in ("one", "two")]
            may = np.logical_and.reduce([wanted_ids[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) for at in places])
            batch = batch.filter(pa.array(may.astype(bool)))
            if not batch.num_rows:
                continue
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sets = shingles(texts, s.words)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(members.tobytes()) for members in sets), np.int64).reshape(-1, 2)
            made = pa.array(list(map(make, texts, sets)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), made], ["first", "high", "low", "made"])

    one, two = id_bits("doc_id", 64 * len(wanted_ids))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text", one.alias("one"), two.alias("two")).mapInArrow(run, "first long, high long, low long, made binary")
    return texts.groupBy("first", "high", "low").agg(F.max("made").alias("made")).join(wanted, ["first", "high", "low"])


def candidate_sets(docs: DataFrame, wanted: DataFrame, s: Similarity) -> DataFrame:
    """(key, n, bits): size and bitmap of each wanted set (key, first, high, low, n)."""
    maps = wanted_texts(docs, wanted, s, lambda text, members: bitmap(members, s.bits(len(members))))
    return wanted.join(maps, ["first", "high", "low"]).select("key", "n", F.col("made").alias("bits"))


def packed_text(text: str, members: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(text.encode(), 3)


def unpacked(packed: list[bytes], s: Similarity) -> list[np.ndarray]:
    """The sets of compressed texts."""
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    return shingles([decompress(x).decode() for x in packed], s.words)


def not_ruled_out(pairs: DataFrame, sets: DataFrame, s: Similarity) -> DataFrame:
    """The pairs (a, b) that may be similar by their bitmaps."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "bits_a"):
            signatures = Signatures([*batch.column("bits_a").to_pylist(), *batch.column("bits_b").to_pylist()])
            i = np.arange(batch.num_rows)
            may = signatures.distances(i, i + len(i)) <= s.difference(batch.column("n").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(may))

    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), x)
    return pairs.select("a", "b", F.expr("n_a + n_b AS n"), "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, pairs: DataFrame, wanted: DataFrame, s: Similarity, folder: str) -> DataFrame:
    """The pairs (a, b) of wanted sets (key, first, high, low, n) that are similar, exactly.

    Texts of these pairs alone are compressed and travel: each b to its a, and an
    a once for every PARTNERS of its partners, which are dealt over as many tasks.
    """
    pairs = write_table(pairs, "pairs", folder=folder)
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    theirs = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"), F.col("b").alias("key"))
    own = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("a").alias("key"))
    asked = write_table(theirs.union(own).join(wanted, "key"), "asked", folder=folder)  # so that its size is known when it meets the texts
    texts = wanted_texts(docs, asked, s, packed_text).withColumnRenamed("made", "packed")
    rows = asked.join(texts, ["first", "high", "low"]).select("a", "share", "role", "key", "n", "packed").repartition("a", "share").sortWithinPartitions("a", "share", "role")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, members = None, None
        for batch in batches(source, "packed", 1 << 20):
            a, b = [], []
            for row in batch.to_pylist():
                if row["role"] == 0:
                    mine, members = row, unpacked([row["packed"]], s)[0]
                    continue
                if mine is None or row["a"] != mine["a"]:
                    continue
                others = unpacked([row["packed"]], s)[0]
                shared = int((members[np.minimum(np.searchsorted(members, others), len(members) - 1)] == others).sum())
                if 100 * shared >= s.percent * (row["n"] + mine["n"] - shared):
                    a.append(row["a"])
                    b.append(row["key"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def linked_sets(docs: DataFrame, unique: DataFrame, s: Similarity, folder: str) -> DataFrame:
    """(node, component) of the sets (key, first, high, low, n, prefix) that are linked with others."""
    tiles = write_table(frequent(tile_rows(unique, s), s), "tiles", folder=folder)
    wanted = unique.select("key", "first", "high", "low", "n").join(tiles.select("key").distinct(), "key", "left_semi")
    wanted = write_table(wanted, "in-tiles", folder=folder)  # so that its size is known when it meets the texts
    sets = write_table(candidate_sets(docs, wanted, s), "candidates", folder=folder)
    found = components(write_table(links(docs, not_ruled_out(first_partners(tiles, s), sets, s), wanted, s, folder), "links", folder=folder), folder)
    for every in (False, True):
        more = write_table(links(docs, fitting_pairs(open_tiles(tiles, found, sets, s, folder), s, every), wanted, s, folder), "links", folder=folder)
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), folder)
    return found


def join_components(df: DataFrame, s: Similarity = Similarity(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``df``."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch_folder(df.sparkSession, "jaccard") as folder:
        rows = write_table(set_rows(docs, s, hot_members(docs, s)), "sets", folder=folder)
        full = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        # Equal sets are one, with the smallest id that has it and a number of its own.
        unique = full.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        unique = write_table(unique.withColumn("key", F.monotonically_increasing_id()), "unique", folder=folder)
        found = linked_sets(docs, unique, s, folder)
        # The sets of one id are of one component.
        own = full.select("doc_id", "high", "low").join(unique.select("high", "low", "key"), ["high", "low"])
        several = own.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("doc_id", "a")
        same = own.join(several, "doc_id").select("a", F.col("key").alias("b"))
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same), folder)

        known = unique.select("high", "low", "first", "key").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        least = known.groupBy("component").agg(F.min("first").alias("component_id"))
        known = write_table(known.join(least, "component").select("high", "low", "component_id"), "known", folder=folder)
        out = rows.join(known, ["high", "low"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return write_table(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "components")


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"), Similarity(3, 90))


JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
u AS (SELECT min(doc_id) AS first, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
m AS (SELECT first, n, unnest(s) AS x FROM u),
i AS (SELECT a.first AS a, b.first AS b, a.n AS n, b.n AS k, count(*) AS shared FROM m a JOIN m b ON a.x = b.x AND a.first < b.first
  AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * shared >= 90 * (n + k - shared)),
two AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM two UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a),
c AS (SELECT a AS first, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component, u.first, s.doc_id) AS component_id
FROM s LEFT JOIN u USING (s) LEFT JOIN c USING (first)"""
