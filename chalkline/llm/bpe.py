"""Byte-level BPE encoding and decoding with the tokenizers library.

Every match of the pre-tokenising pattern is encoded on its own, so a worker
keeps the ids of the matches it has met and asks the library for each new one
only.  The pattern gives a match at most one leading space and never runs from
one word over a single space into the next, so texts are cut at single spaces
first and the ids of whole words are kept as well.  Bytes are shown to the library as printable characters (the byte table);
decoding reverses the table, and characters that tokens split are put together
again because bytes are joined before they are read as UTF-8.

The added tokens of a .json vocabulary (such as <|endoftext|>) are found first,
as the library does; what stands between them is encoded as said above.

Null texts count as empty.  Rows are independent: repeated rows, ties and extra
columns pass through; an empty table gives an empty result.  Texts of any
length are handled whole, in slices of Arrow batches of bounded size.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, lists, read

#: Matches a worker remembers before it starts afresh (about 100 MB).
REMEMBERED = 500_000


@lru_cache(1)
def byte_table() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stays, the rest is numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def shown(data: bytes) -> str:
    """Bytes as the characters of the byte table."""
    return data.decode("latin-1").translate(byte_table())


SPACE = shown(b" ")


def _merges(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The two tokens each token is merged from: what lower ranks make of its bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((shown(parts[0]), shown(parts[1])))
    return out


@lru_cache(4)
def added_tokens(vocabulary: str) -> dict[str, int]:
    """Added token -> id of a tokenizers .json file; rank files have none."""
    if not vocabulary.endswith(".json"):
        return {}
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary).get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in found.values()):
        raise ValueError(f"{vocabulary}: added tokens that depend on their neighbours are not supported")
    return {t.content: i for i, t in found.items()}


@lru_cache(4)
def model(vocabulary: str):
    """(BPE model, bytes of each id) of a .tiktoken rank file or a tokenizers .json file."""
    from tokenizers import Tokenizer, models

    if vocabulary.endswith(".json"):
        bpe = Tokenizer.from_file(vocabulary)
        back = {c: b for b, c in byte_table().items()}
        words = sorted((i, w) for w, i in bpe.get_vocab(with_added_tokens=False).items())
        special = {i for i, t in bpe.get_added_tokens_decoder().items() if t.special}
        table = [b""] * (1 + max([i for i, _ in words] + [*added_tokens(vocabulary).values()], default=-1))
        for i, w in words:
            table[i] = w.encode() if i in special else bytes(back[c] for c in w)
        for w, i in added_tokens(vocabulary).items():
            table[i] = w.encode()
        return bpe.model, table
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = [b""] * (1 + max(ranks.values()))
    for data, i in ranks.items():
        table[i] = data
    return models.BPE({shown(k): v for k, v in ranks.items()}, _merges(ranks), ignore_merges=True), table


class Pieces(dict):
    """Match of the pattern -> its ids, as bytes of unsigned 32-bit integers."""

    def __init__(self, bpe):
        self.tokenize = bpe.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = self.ids(piece)
        return out

    def ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(shown(piece.encode()))]).tobytes()

    def spaced(self, word: str) -> bytes:
        """Ids of a word of letters and the space before it."""
        if word.isascii():  # such letters are shown as they are
            return array("I", [t.id for t in self.tokenize(SPACE + word)]).tobytes()
        return self.ids(" " + word)


class Uneven(Exception):
    """A cut at single spaces would change the matches of this text."""


class Words(dict):
    """Text between two single spaces -> ids of it and the space before."""

    def __init__(self, pieces: Pieces, split):
        self.pieces, self.split = pieces, split

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one match
            out = self.pieces.spaced(word)
        elif not word or word[0].isspace() or word[-1].isspace():
            raise Uneven
        elif word[-1] in ".,!?:;" and word[:-1].isalpha():  # two matches
            out = self[word[:-1]] + self.pieces[word[-1]]
        else:
            end, line, start = word.partition("\n")
            if line and start.isalpha() and not end[-1:].isspace():  # the line's end is a match
                return self[end] + self.pieces[line] + self.pieces[start]
            return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))
        if len(self) < REMEMBERED:
            self[word] = out
        return out


class Encoder:
    """Ids of whole texts; one per Python worker.  Added tokens are ordinary text unless ``added``."""

    def __init__(self, vocabulary: str, pattern: str, added: bool = False):
        import regex

        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(model(vocabulary)[0])
        self.words = Words(self.pieces, self.split)
        self.added = {w: np.array([i], "<u4") for w, i in added_tokens(vocabulary).items()} if added else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def of_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(map(text.__contains__, self.added)):
            return np.concatenate([self.added[x] if i % 2 else self.plain(x) for i, x in enumerate(self.cut(text))])
        return self.plain(text)

    def plain(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise Uneven
            out = self.of_pieces(first) + b"".join(map(self.words.__getitem__, rest))
        except Uneven:
            out = self.of_pieces(text)
        return np.frombuffer(out, "<u4")


    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of several texts: distinct words are looked up once, and their ids gathered in place."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        words = pc.split_pattern(texts, " ")
        starts, flat = np.asarray(words.offsets)[:-1] - words.offsets[0].as_py(), words.flatten().dictionary_encode()
        known, codes = flat.dictionary.to_pylist(), np.asarray(flat.indices).astype(np.int64)
        later = np.ones(len(codes), bool)
        later[starts] = False
        ids: list[bytes] = [b""] * len(known)
        odd = np.zeros(len(known) + 1, bool)
        for i in np.unique(codes[later]).tolist():
            try:
                ids[i] = self.words[known[i]]
            except Uneven:
                odd[i] = True
        first = [known[i] for i in codes[starts].tolist()]
        codes[starts] = np.arange(len(known), len(known) + len(first))
        odd = np.r_[odd[:-1], [x[-1:].isspace() for x in first]]
        whole = np.logical_or.reduceat(odd[codes], starts)  # texts that a cut at single spaces would change
        for token in self.added:
            whole |= np.asarray(pc.match_substring(texts, token))
        ids += [b"" if w else self.of_pieces(x) for x, w in zip(first, whole.tolist(), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, offsets = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        out = table[np.arange(int(ends[-1])) + np.repeat(offsets[codes] - (ends - each), each)]
        parts = np.split(out, np.r_[0, ends][starts][1:])
        return [self(texts[i].as_py()) if w else part for i, (part, w) in enumerate(zip(parts, whole.tolist(), strict=True))]


@lru_cache(4)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern, added=True)


@lru_cache(4)
def byte_lengths(vocabulary: str) -> np.ndarray:
    return np.array([len(x) for x in model(vocabulary)[1]], np.int64)


def char_offsets(text: str, ids: np.ndarray, vocabulary: str) -> np.ndarray:
    """For each token, the character of ``text`` in which its first byte lies."""
    starts = np.cumsum(byte_lengths(vocabulary)[ids]) - byte_lengths(vocabulary)[ids]
    if text.isascii():
        return starts.astype(np.int32)
    data = np.frombuffer(text.encode(), np.uint8)
    return (np.cumsum((data & 0xC0) != 0x80) - 1)[starts].astype(np.int32)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """``df`` and the columns ids array<int> and, if asked for, offsets array<int>.

    ``pattern`` must keep words at single spaces apart, as said above.
    offsets: the character of the text in which each token starts.  Input
    columns named ids or offsets are replaced.
    """
    new = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("offsets", T.ArrayType(T.IntegerType(), False))] * offsets]
    df = df.drop(*(f.name for f in new))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary, pattern)
        for batch in batches(source, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            ids = [ids_of(x) for x in texts]
            n = [len(x) for x in ids]
            out = [lists(np.concatenate(ids).astype(np.int32), n, pa.int32())]
            if offsets:
                out.append(lists(np.concatenate([char_offsets(x, i, vocabulary) for x, i in zip(texts, ids, strict=True)]), n, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` and the column decoded binary: the bytes that the ids stand for (null for null)."""
    df = df.drop("decoded")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(vocabulary)[1]
        for batch in source:
            data = [None if x is None else b"".join(map(table.__getitem__, x.values.to_numpy().tolist())) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, public_tokenizers.PATTERN).drop("text")
    return decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.try_element_at("offsets", F.lit(-1)).alias("last_offset"),
    )
