"""Token-id files: canonical length-limited Huffman coding of ids from global counts.

Format.  A folder holds two Parquet tables.  ``codes`` (id, length) is the whole
code: canonical codes follow from the lengths, shorter codes first, ids
ascending among equal lengths.  ``records/file=N`` holds documents in ascending
order of doc_id (N ascending too): doc_id, n_tokens, first (ids before it in the
file), payload (its codes, most significant bit first, padded to whole bytes)
and checkpoints (the bit offset of every block of BLOCK ids in the payload).
Blocks decode independently by one table look-up an id, many blocks in step.

Null texts count as empty (one record with the end id).  Ids are any 64-bit
integers, compared as such.  Repeated rows give one record each, side by side;
those of an id that fills several files are dealt over them.  Rows with a null
doc_id come first (with those of the least integer, -2^63).  Extra columns are
left out; an empty table gives files without records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm import bpe
from chalkline.llm.common import batches, lists, read, scratch_folder, shared_dir, write_table

#: Ids in a block, the unit of independent decoding.
BLOCK = 256
#: Where rows with a null doc_id stand in the order.
NULL_ID = -(1 << 63)
#: Longest code in bits; it is raised when there are more ids than such codes.
LIMIT = 16
#: Ids in a file, about, as long as there are no more than FILES files.
FILE_IDS, FILES = 8_000_000, 65_536
#: Rows for each file that are looked at to part the ids into files (8 MB at most).
SAMPLED = 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)
    n, levels, weights = len(order), [], single
    for _ in range(limit - 1):  # each level merges the symbols with the pairs of the level below
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([single, pairs])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        weights = both[at]
    take, got = 2 * n - 2, np.zeros(n, np.int64)
    for is_single in reversed(levels):
        symbols = int(is_single[:take].sum())
        got[:symbols] += 1
        take = 2 * (take - symbols)
    got[:take] += 1
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as integers: ascending by (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for bits in np.unique(lengths[order]):
        same = order[lengths[order] == bits]
        code <<= int(bits) - last
        codes[same] = code + np.arange(len(same))
        code, last = code + len(same), int(bits)
    return codes


def pack(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of documents one after another, each from a whole byte on.

    Returns all bytes, bytes of each document, checkpoints, checkpoints of each document.
    """
    size = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(counts)
    bits = ends[last] - ends[last - counts]
    n_bytes = (bits + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)[:-1]]) * 8
    inside = ends[:-1] - np.repeat(ends[last - counts], counts)
    at = inside + np.repeat(base, counts)
    words = np.zeros(int(n_bytes.sum()) // 4 + 3, np.uint64)
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(starts):
        words[word[starts]] += np.add.reduceat(value >> np.uint64(32), starts)
        words[word[starts] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
    position = np.arange(len(ids)) - np.repeat(last - counts, counts)
    checkpoints = inside[position % BLOCK == 0].astype(np.int32)
    return words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())], n_bytes, checkpoints, (counts + BLOCK - 1) // BLOCK


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits) for each value of the next ``width`` bits."""
    width = max(1, int(lengths.max(initial=0)))
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (width - lengths[used]), kind="stable")]
    spans = 1 << (width - lengths[used])
    ids, bits = np.zeros(1 << width, np.int64), np.ones(1 << width, np.int64)
    ids[: spans.sum()], bits[: spans.sum()] = np.repeat(used, spans), np.repeat(lengths[used], spans)
    return ids, bits, width


def unpack(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of blocks that begin at bits ``starts`` and hold ``counts`` ids: all blocks in step."""
    ids, bits, width = table
    data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    put = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.int64)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, side="left"))  # blocks with more than ``step`` ids
        p = at[:live]
        byte = p >> 3
        window = data[byte] << 24 | data[byte + 1] << 16 | data[byte + 2] << 8 | data[byte + 3]
        value = (window >> (32 - width - (p & 7))) & ((1 << width) - 1)
        out[put[:live] + step] = ids[value]
        at[:live] += bits[value]
    return out


def count_ids(df: DataFrame, ids: str, kind: str, size: int) -> np.ndarray:
    """Global counts of the ids in a binary column; one row for each id and task is shuffled."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in source:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if len(x.as_buffer()) > 4 * size else 0
            small = b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= 4 * size)
            total += np.bincount(np.frombuffer(small, kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = df.select(ids).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(size, np.int64)
    for row in rows:
        counts[row.id] = row.n
    return counts


def write_files(df: DataFrame, vocabulary: str, pattern: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> None:
    """Encode texts, append ``end_id`` to each, and write the files under ``path``."""
    size = max(len(bpe.model(vocabulary)[1]), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.encoder(vocabulary, pattern), np.array([end_id], kind)
        for batch in batches(source, "text"):
            ids = [np.concatenate([x.astype(kind), end]) for x in encoder.batch(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    spark = df.sparkSession
    with scratch_folder(spark, "token-ids") as folder:
        source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        plain = write_table(source.mapInArrow(encode, "doc_id long, n_tokens long, ids binary"), "ids", folder=folder)
        counts = count_ids(plain, "ids", kind, size)
        lengths = code_lengths(counts)
        used = np.flatnonzero(lengths)
        spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
        bounds = file_bounds(plain, min(FILES, max(1, -(-int(counts.sum()) // file_ids))))
        write_records(plain, bounds, kind, lengths, path)


def file_bounds(plain: DataFrame, files: int) -> np.ndarray:
    """The ids that part the rows into ``files`` of about equal numbers, by the ids of a sample of rows of bounded size."""
    if files == 1:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLED * files / max(1, plain.count()))
    keys = plain.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"))
    keys = keys if share == 1 else keys.sample(share, seed=8)
    found = np.sort(keys.toArrow().column("key").to_numpy())  # about SAMPLED for each of FILES files at most, or all rows of a smaller table
    return found[np.arange(1, files) * len(found) // files] if len(found) else found


def write_records(plain: DataFrame, bounds: np.ndarray, kind: str, lengths: np.ndarray, path: str) -> None:
    codes = canonical(lengths)

    def files_of(ids: pa.Array) -> np.ndarray:
        """How many bounds are below each id; the rows of an id that is a bound are dealt over the files it parts."""
        ids = ids.fill_null(NULL_ID).to_numpy()
        low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
        return (low + np.arange(len(ids)) % (high - low + 1)).astype(np.int32)

    def encoded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "ids"):
            n = batch.column("n_tokens").to_numpy()
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind).astype(np.int64)
            data, n_bytes, checkpoints, n_checkpoints = pack(ids, n, codes, lengths)
            ends = np.concatenate([[0], np.cumsum(n_bytes)]).astype(np.int32)
            payload = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(files_of(batch.column("doc_id"))), batch.column("doc_id"), batch.column("n_tokens"), payload, lists(checkpoints, n_checkpoints, pa.int32())], ["file", "doc_id", "n_tokens", "payload", "checkpoints"])

    coded = plain.select("doc_id", "n_tokens", "ids").mapInArrow(encoded, "file int, doc_id long, n_tokens long, payload binary, checkpoints array<int>")
    order = Window.partitionBy("file").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    coded.repartitionById(len(bounds) + 1, "file").withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("long"))).write.partitionBy("file").option("compression", "none").parquet(f"{path}/records")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # one row for each id of the vocabulary at most
    lengths = np.zeros(1 + max([r.id for r in codes], default=0), np.int64)
    for r in codes:
        lengths[r.id] = r.length
    records = spark.read.schema("doc_id long, n_tokens long, payload binary, checkpoints array<int>, first long, file int").parquet(f"{path}/records")
    ends, before = [], 0
    for r in sorted(records.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.file):  # one row for each of at most FILES + 1 files
        ends.append((r.file, before))
        before += r.n
    starts = spark.createDataFrame(ends, "file int, before long")
    built: list[tuple] = []

    def decoded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(decoding_table(lengths))
        for batch in batches(source, "payload", 1 << 20):
            n = batch.column("n_tokens").to_numpy()
            payload = batch.column("payload").to_pylist()
            data = np.frombuffer(b"".join(payload), np.uint8)
            sizes = np.array([len(x) for x in payload], np.int64)
            marks = batch.column("checkpoints")
            per_doc = marks.value_lengths().to_numpy()
            starts = marks.flatten().to_numpy().astype(np.int64) + np.repeat((np.cumsum(sizes) - sizes) * 8, per_doc)
            nth = np.arange(len(starts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            counts = np.minimum(BLOCK, np.repeat(n, per_doc) - nth * BLOCK)
            ids = unpack(data, starts, counts, built[0]).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(n * 4)])
            out = pa.array([ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("first"), batch.column("n_tokens"), out], ["file", "doc_id", "first", "n_tokens", "ids"])

    plain = records.select("file", "doc_id", "first", "n_tokens", "payload", "checkpoints").mapInArrow(decoded, "file int, doc_id long, first long, n_tokens long, ids binary")
    return plain.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2, path)
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
