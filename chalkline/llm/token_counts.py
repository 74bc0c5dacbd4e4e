"""Token counts of byte-level BPE vocabularies by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; those not met before are held together as one flat
array of symbols with the row of each.  In every round each row finds the lowest
rank among its pairs and merges that pair wherever it stands (from the left where
it overlaps itself), all rows at once; rows without a pair left are done, and
their symbols are counted.  A row of more than LONG symbols takes its ranks from
a heap instead, so each of its rounds touches only the places of one rank.

A merged symbol can only take part in merges of higher rank (checked when a
vocabulary is loaded), which is why a rank can be applied everywhere at once.

Null texts count as empty: 0 tokens, 0 bytes.  Rows are independent: repeated
rows, ties and extra columns pass through; an empty table gives an empty result.
Texts are read whole, in slices of Arrow batches of bounded size; what a worker
remembers is bounded.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.bpe import _merges, added_tokens, byte_table, shown
from chalkline.llm.common import batches, read

NONE = np.int64(1 << 40)  # rank of a pair that doesn't merge
#: Rows with more symbols are merged by themselves.
LONG = 512
#: Stretches and pre-tokens a worker remembers before it starts afresh (about 100 MB each).
REMEMBERED = 600_000


def _json_merges(vocabulary: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    with open(vocabulary, encoding="utf-8") as lines:
        spec = json.load(lines)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        raise ValueError(f"{vocabulary}: only byte-level BPE without a normalizer or a prefix space is supported")
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


class Merges:
    """The merges of a tokenizers .json or a .tiktoken rank file as sorted arrays."""

    def __init__(self, vocabulary: str):
        self.whole: frozenset[bytes] = frozenset()  # pre-tokens that are one token whatever the merges say
        if vocabulary.endswith(".json"):
            ids, merges = _json_merges(vocabulary)
        else:
            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            ids, merges, self.whole = {shown(k): v for k, v in ranks.items()}, _merges(ranks), frozenset(ranks)
        self.base = np.array([ids[byte_table()[b]] for b in range(256)], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        left, right = (np.array([ids[m[side]] for m in merges], np.int64) for side in (0, 1))
        made_at = {int(x): i for i, x in reversed(list(enumerate(self.made.tolist())))}
        if any(made_at.get(x, -1) >= i for part in (left, right) for i, x in enumerate(part.tolist())):
            raise ValueError(f"{vocabulary}: a merge stands before the one that makes its parts")
        keys = left << 32 | right
        self.keys, self.rank = np.sort(keys), np.argsort(keys, kind="stable")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the pre-tokens."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.where([p in self.whole for p in pieces], 1, sizes) if self.whole else sizes.copy()
        for i in np.flatnonzero((sizes > LONG) & (out > 1)):
            out[i] = self.count_long(self.base[np.frombuffer(pieces[i], np.uint8)])
        rows = np.flatnonzero((sizes <= LONG) & (out > 1))
        symbols = self.base[np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)]
        row = np.repeat(rows, sizes[rows])
        while len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lengths = np.diff(np.r_[starts, len(row)])
            ranks = np.append(self.ranks(symbols[:-1], symbols[1:]), NONE)
            ranks[starts[1:] - 1] = NONE  # the last symbol of a row has no pair
            lowest = np.minimum.reduceat(ranks, starts)
            out[row[starts]] = lengths
            hit = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks < NONE))
            hit = hit[self.alternate(np.diff(hit, prepend=-2) == 1)]
            symbols[hit] = self.made[ranks[hit]]
            stays = np.repeat(lowest < NONE, lengths)
            stays[hit + 1] = False
            symbols, row = symbols[stays], row[stays]
        return out

    @staticmethod
    def alternate(joined: np.ndarray) -> np.ndarray:
        """Which places to take, from the left, where ``joined`` ones overlap the place before."""
        at = np.arange(len(joined))
        return (at - np.maximum.accumulate(np.where(joined, 0, at))) % 2 == 0

    def count_long(self, symbols: np.ndarray) -> int:
        """Surviving symbols of one row: its places are kept by rank, ranks on a heap."""
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # neighbours that are still there; n: none
        now, places, heap = np.full(n + 1, NONE), {}, []

        def add(at: np.ndarray) -> None:
            at = at[(at >= 0) & (after[np.minimum(at, n - 1)] < n)]
            now[at] = ranks = self.ranks(symbols[at], symbols[after[at]])
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ranks)) + 1):
                if len(part) and (rank := int(ranks[part[0]])) < NONE:
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(heap, rank)
                    places[rank].append(at[part])

        add(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[now[at] == rank]
            if not len(at):
                continue
            at = at[self.alternate(np.r_[False, after[at[:-1]] == at[1:]])]
            gone = after[at]
            symbols[at], now[at], now[gone] = self.made[rank], NONE, NONE
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            now[before[at][before[at] >= 0]] = NONE
            add(np.unique(np.r_[before[at], at]))
        return left


@lru_cache(4)
def merges(vocabulary: str) -> Merges:
    return Merges(vocabulary)


class Counter:
    """Token counts of whole texts; one per Python worker.

    Texts are cut before single spaces between two other characters, which no
    pre-token crosses, and each distinct stretch is counted once.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.merges, self.split = merges(vocabulary), regex.compile(pattern).findall
        self.added = list(added_tokens(vocabulary))
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)").split
        self.pieces: dict[str, int] = {}
        self.stretches: dict[str, int] = {}

    def learn(self, stretches: list[str]) -> None:
        """Remember the counts of stretches, and of their pre-tokens."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        parts = [self.split(x) for x in stretches]
        new = [p for p in dict.fromkeys(p for part in parts for p in part) if p not in self.pieces]
        self.pieces.update(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
        self.stretches.update((x, sum(map(self.pieces.__getitem__, part))) for x, part in zip(stretches, parts, strict=True))

    def of(self, stretches: list[str]) -> np.ndarray:
        new = [x for x in dict.fromkeys(stretches) if x not in self.stretches]
        if len(self.stretches) + len(new) > REMEMBERED:
            self.stretches.clear()
            new = list(dict.fromkeys(stretches))
        self.learn(new)
        return np.fromiter(map(self.stretches.__getitem__, stretches), np.int64, len(stretches))

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Counts of texts without added tokens."""
        if not len(texts):
            return np.zeros(0, np.int64)
        words = pc.split_pattern(texts, " ")
        starts, flat = np.asarray(words.offsets)[:-1] - words.offsets[0].as_py(), words.flatten().dictionary_encode()
        known, codes = flat.dictionary.to_pylist(), np.asarray(flat.indices)
        uneven = np.array([not w or w[0].isspace() or w[-1].isspace() for w in known], bool)[codes]
        first = [known[i] for i in codes[starts].tolist()]
        uneven[starts] = [w[-1:].isspace() for w in first]
        whole = np.flatnonzero(np.logical_or.reduceat(uneven, starts))  # texts that a cut at single spaces would change
        later = np.ones(len(codes), bool)
        later[starts] = False
        used = np.unique(codes[later & ~uneven])
        each = np.zeros(len(known), np.int64)
        each[used] = self.of([" " + known[i] for i in used.tolist()])
        out = each[codes]
        out[starts] = self.of(first)
        out = np.add.reduceat(out, starts)
        if len(whole):
            odd = [self.split(texts[i].as_py()) for i in whole.tolist()]
            new = [p for p in dict.fromkeys(p for part in odd for p in part) if p not in self.pieces]
            found = dict(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
            out[whole] = [sum(found[p] if p in found else self.pieces[p] for p in part) for part in odd]
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = texts.cast(pa.large_string()).fill_null("")
        has = np.zeros(len(texts), bool)
        for token in self.added:
            has |= np.asarray(pc.match_substring(texts, token))
        out = np.zeros(len(texts), np.int64)
        out[~has] = self.plain(texts.filter(pa.array(~has)))
        if has.any():
            rows = np.flatnonzero(has)
            parts = [self.cut(texts[i].as_py()) for i in rows.tolist()]
            row = np.repeat(rows, [len(p) for p in parts])
            np.add.at(out, row, self.plain(pa.array([x for p in parts for x in p], pa.large_string())))
            out[rows] += [len(p) - 1 for p in parts]  # the added tokens between the parts
        return out


@lru_cache(4)
def counter(vocabulary: str, pattern: str) -> Counter:
    return Counter(vocabulary, pattern)


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` and the columns n_bytes, n_tokens long of each text; input columns of these names are replaced.

    ``pattern`` must keep words at single spaces apart and give a match at most
    one leading space.  Added tokens of a .json vocabulary are found in the texts
    first, as its library does by default.
    """
    new = [T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)]
    df = df.drop(*(f.name for f in new))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, pattern)
        for batch in batches(source, text):
            texts = batch.column(text)
            sizes = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(count(texts))], [*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def op13_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
