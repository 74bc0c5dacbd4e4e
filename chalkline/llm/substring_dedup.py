"""Substring deduplication by content-defined chunking with a gear rolling hash.

Texts are cut, in UTF-8, after white space where the gear hash of the last 16
bytes is small, so an insertion moves the cuts near it only.  Stretches of
``min_bytes`` or more without ASCII white space (scripts that do not part words,
unbroken data) are also cut after any character where that hash is smaller
still.  Only where neither comes within ``max_chunk`` is a cut forced; that
leaves periodic stretches and very rare others.

What is compared are spans: the adjacent chunks from each chunk on, and up to
each chunk, that just reach ``min_bytes``, told apart by a 64-bit digest of their chunks' digests.
The first occurrence of a span, by doc_id and place, stays; those that are
repeats as a whole are removed from the text.  Chunks that are known singly but
never stood side by side are no repeat.  Any longer passage between two cuts is
the union of such spans, so it is found whole.

Skew: a digest is shuffled once for each slice of the input at most; later
occurrences in a slice are repeats for certain and go straight to their document.

Null and empty texts stay as they are.  Rows with a null doc_id stay and count
for no one.  A row that is repeated as a whole is one document: each copy gets
the same result.  Rows that share a doc_id but not a text are documents of their
own, in the order of a 64-bit digest of the text.  Extra columns pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, read


@dataclass(frozen=True)
class Settings:
    cut_share: int = 64  # of 256: a word end in four is a cut
    min_chunk: int = 8
    max_chunk: int = 512
    min_bytes: int = 96
    unspaced_share: int = 16  # of 256: within stretches without white space, a character in sixteen is a cut


def _gear() -> np.ndarray:
    """A fixed pseudo-random word for each byte value (splitmix64 of the value)."""
    z = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def chunk_ends(data: bytes, s: Settings) -> list[int]:
    """Where the chunks of a text end; the last is the text's end."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):  # h[i] = sum of gear[b[i-k]] << k over the last 16 bytes
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    h >>= np.uint32(24)
    space = SPACES[raw]
    may = (h < s.cut_share) & space
    lengths = np.diff(np.flatnonzero(space), prepend=-1, append=len(data))  # stretches, each with the space behind it
    if lengths.max() > s.min_bytes:
        character_ends = np.append(raw[1:] & 0xC0 != 0x80, True)[: len(data)]
        may |= np.repeat(lengths > s.min_bytes, lengths)[: len(data)] & character_ends & (h < s.unspaced_share)
    ends, last = [], 0
    for cut in [*(np.flatnonzero(may) + 1).tolist(), len(data)]:
        while cut - last > s.max_chunk:
            forced = last + s.max_chunk
            while forced > last + 1 and data[forced] & 0xC0 == 0x80:  # not within a character
                forced -= 1
            ends.append(forced)
            last = forced
        if cut - last >= s.min_chunk or cut == len(data) > last:
            ends.append(cut)
            last = cut
    return ends


def spans_of(ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First and last chunk of the spans that reach ``min_bytes`` and do not without their first or without their last chunk."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    i, j = np.arange(len(ends)), np.arange(len(ends))
    to = np.searchsorted(ends, starts + s.min_bytes, "left")
    since = np.searchsorted(starts, ends - s.min_bytes, "right") - 1
    first, last = np.concatenate([i[to < len(ends)], since[since >= 0]]), np.concatenate([to[to < len(ends)], j[since >= 0]])
    pairs = np.unique(first << 32 | last)
    return pairs >> 32, pairs & (1 << 32) - 1


def digest_of(text: str):
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col(text))


# A place in a document is one integer: the start, then 10 bits of the length.
def repeats(df: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tag long, places array<long>: the spans of each document that occur before, elsewhere or in it."""
    assert s.min_bytes + s.max_chunk <= 1024, "a span's length must fit in its place"

    def chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches(source, "text"):
            keys, sizes, places = [], [], []
            for value in batch.column("text").to_pylist():
                data = value.encode()
                ends = np.array(chunk_ends(data, s), np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                chunk = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends)).tobytes()
                first, last = spans_of(ends, s)
                starts, ends = starts[first], ends[last]
                keys.append(np.fromiter((digest(chunk[8 * i : 8 * j + 8]) for i, j in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(ends)))
                sizes.append(len(ends))
                places.append(starts << 10 | ends - starts)
            doc, tag = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "tag"))
            key, place = np.concatenate(keys).view(np.int64), np.concatenate(places)
            order = np.lexsort((place, tag, doc, key))
            key, at = key[order], tuple(x[order] for x in (doc, tag, place))
            again, same = _later(key, at, None)
            keep = ~(again & same)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (np.where(again, at[0], key), *at, again)], ["key", "doc", "tag", "place", "known"])

    def later(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in source:
            key, *at = (batch.column(c).to_numpy() for c in ("key", "doc", "tag", "place"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            open_ = ~known
            out = known.copy()
            if open_.any():
                again, same = _later(key[open_], tuple(x[open_] for x in at), first)
                out[open_] = again & ~same
                started = np.flatnonzero(~again)
                if len(started):
                    i = np.flatnonzero(open_)[started[-1]]
                    first = (key[i], *(x[i] for x in at))
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in at], ["doc", "tag", "place"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc"), digest_of(text).alias("tag"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.col("text") != ""))
    place = "doc long, tag long, place long"
    dealt = rows.mapInArrow(chunks, f"key long, {place}, known boolean").repartition("key").sortWithinPartitions("known", "key", "doc", "tag", "place")
    return dealt.mapInArrow(later, place).groupBy("doc", "tag").agg(F.sort_array(F.collect_set("place")).alias("places"))  # the spans of one document


def _later(key: np.ndarray, at: tuple[np.ndarray, ...], first: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: is the key met before, and is this the very document and place where it was met first?"""
    n = len(key)
    begins = np.ones(n, bool)
    begins[1:] = key[1:] != key[:-1]
    if first is not None and n and key[0] == first[0]:
        begins[0] = False
    since = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
    same = np.ones(n, bool)
    for x, earlier in zip(at, first[1:] if first is not None else (0,) * len(at), strict=True):
        same &= np.where(since < 0, earlier, x[since]) == x
    return ~begins, same


def runs(places: list[int], min_bytes: int) -> list[tuple[int, int]]:
    """(start, end) in bytes of runs of adjacent or overlapping places, in order, that are long enough."""
    out: list[list[int]] = []
    for p in places:
        start = p >> 10
        end = start + (p & 1023)
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= min_bytes]


def dedupe(df: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeats cut from the text, and removed_spans (array of start, end in bytes), removed_bytes long."""
    new = [T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("removed_bytes", T.LongType())]
    df = df.drop(*(f.name for f in new), "__doc", "__tag", "__places")

    names = df.columns

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, text):
            texts, spans = [], []
            for value, places in zip(batch.column(text).to_pylist(), batch.column("__places").to_pylist(), strict=True):
                found = runs(places, s.min_bytes) if places else []
                if found:
                    data, at = value.encode(), 0
                    kept = []
                    for a, b in found:
                        kept.append(data[at:a])
                        at = b
                    value = b"".join([*kept, data[at:]]).decode()
                texts.append(value)
                spans.append([{"start": a, "end": b} for a, b in found])
            columns = [pa.array(texts, batch.schema.field(text).type) if c == text else batch.column(c) for c in names]
            removed = [sum(x["end"] - x["start"] for x in spans_) for spans_ in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(removed, pa.int64())], [*names, *(f.name for f in new)])

    found = repeats(df, s, doc_id, text).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("places").alias("__places"))
    joined = df.join(found, (F.col(doc_id).cast("long") == F.col("__doc")) & (digest_of(text) == F.col("__tag")), "left").select(*(F.col(f"`{c}`") for c in df.columns), "__places")
    return joined.mapInArrow(cut, T.StructType([*df.schema.fields, *new]))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedupe(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", "removed_spans", "removed_bytes", (F.col("removed_bytes") > 0).alias("has_repeats"))
