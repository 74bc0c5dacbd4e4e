"""Maximal periodic runs of words in whole texts, found by suffix trees of each text and its reversal.

A run is a stretch of words in which words ``period`` apart are identical, that
no neighbouring word extends.  Every run has a Lyndon word as its root: the
longest Lyndon word that starts at some place of it, under an order of words or
the reverse order.  So there are at most two candidates for each place.  Each is
extended to both sides by its longest common extensions: in Ukkonen's suffix tree
of the words to the right, in that of their reversal to the left.  Extensions are
the depths of lowest common ancestors, each a minimum over the tree's Euler tour
that a sparse table gives in constant time.

Trees are built for the stretches of a text that can hold a run, which leaves out
nothing: in a run of ``exponent`` periods or more, all words but those of the last
period come again within a period, and that is at most 1/(exponent - 1) of them.
Stretches are cut at words that don't come again so soon until all of them do.
A worker holds a stretch's trees at once: some 500 bytes for each of its words.

Words are what stands between spaces, tabs, line ends, vertical tabs and form
feeds, compared as bytes.  Null and empty texts, and those of white space, have no
words, no runs and an empty collapsed text.  Rows are independent: repeated rows,
ties and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm.common import batches, read

FAR = np.int64(1 << 60)  # distance to the next equal word where there is none
#: Words whose trees are queried together.
TOGETHER = 1 << 16
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def euler_tour(symbols: list[int]) -> tuple[list[int], list[int]]:
    """(leaves, depths) of the suffix tree of ``symbols``, which end with one smaller than all others.

    leaves: the suffixes in ascending order; depths: the length that each shares
    with the suffix before it, which is the depth at which the tour turns.
    """
    # An inner node is a number, its edge symbols[start:stop]; a leaf is ~suffix, its edge from first[suffix] on.
    start, stop, link, kids, first = [0], [0], [0], [{}], [0] * len(symbols)
    node = length = 0  # the active point: ``length`` symbols from symbols[edge] on below ``node``
    edge = leaf = 0
    for i, symbol in enumerate(symbols):
        fresh = -1  # an inner node that waits for its suffix link
        while leaf <= i:
            if length == 0:
                edge = i
            below, head = kids[node], symbols[edge]
            child = below.get(head)
            if child is None:
                below[head], first[leaf] = ~leaf, i
                if fresh >= 0:
                    link[fresh], fresh = node, -1
            else:
                if child >= 0:
                    at, size = start[child], stop[child] - start[child]
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                else:
                    at = first[~child]
                at += length
                if symbols[at] == symbol:
                    length += 1
                    if fresh >= 0:
                        link[fresh] = node
                    break
                made = len(kids)
                start.append(at - length)
                stop.append(at)
                link.append(0)
                kids.append({symbols[at]: child, symbol: ~leaf})
                below[head], first[leaf] = made, i
                if child >= 0:
                    start[child] = at
                else:
                    first[~child] = at
                if fresh >= 0:
                    link[fresh] = made
                fresh = made
            leaf += 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = leaf
    leaves, depths, todo = [], [], [(0, 0, 0)]
    while todo:
        node, depth, shared = todo.pop()
        if node < 0:
            leaves.append(~node)
            depths.append(shared)
            continue
        depth += stop[node] - start[node]
        (_, least), *others = sorted(kids[node].items())
        todo.extend((child, depth, depth) for _, child in reversed(others))
        todo.append((least, depth, shared))
    return leaves, depths


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one of smaller rank, or the end: there its longest Lyndon word ends."""
    n = len(ranks)
    out = [n] * n
    for i in range(n - 1, -1, -1):
        j, rank = i + 1, ranks[i]
        while j < n and ranks[j] > rank:
            j = out[j]
        out[i] = j
    return out


class Extensions:
    """Longest common extensions within several texts, by one sparse table of minima over their tours."""

    def __init__(self, tours: list[tuple[list[int], list[int]]]):
        self.base = np.cumsum([0, *(len(leaves) for leaves, _ in tours)])
        self.rank = np.empty(self.base[-1], np.int64)  # place of each suffix in the tour
        for base, (leaves, _) in zip(self.base.tolist(), tours, strict=False):
            self.rank[base + np.array(leaves)] = base + np.arange(len(leaves))
        self.minima = [np.array([x for _, depths in tours for x in depths], np.int32)]
        width = 1
        while 2 * width <= max((len(leaves) for leaves, _ in tours), default=0):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common lengths of different suffixes, as places in all texts one behind the other."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            minima = self.minima[k]
            out[at] = np.minimum(minima[low[at]], minima[high[at] - (1 << k) + 1])
        return out


def runs_of(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of all runs of two periods or more in lists of word numbers from 1 on."""
    ahead, back, text, places, roots, last = [], [], [], [], [], 0
    for number, words in enumerate(texts):
        n = len(words)
        ahead.append(euler_tour([*words, 0]))
        back.append(euler_tour([*words[::-1], 0]))
        ranks = [0] * (n + 1)
        for rank, leaf in enumerate(ahead[-1][0]):
            ranks[leaf] = rank
        del ranks[n]
        for order in (ranks, [-x for x in ranks]):
            ends = np.array(next_smaller(order))
            at = np.flatnonzero(ends < n)
            text.append(np.full(len(at), number))
            places.append(at)
            roots.append(ends[at] - at)
        last += n
    text, i, period = np.concatenate(text), np.concatenate(places), np.concatenate(roots)
    sizes, right, left = np.array([len(x) for x in texts])[text], Extensions(ahead), Extensions(back)
    base = right.base[text]
    end = i + period + right(base + i, base + i + period)
    start = i - left(base + sizes - i, base + sizes - i - period)
    found = np.flatnonzero(end - start >= 2 * period)
    out = np.unique(np.stack([text[found], start[found], end[found], period[found]]), axis=1)
    return out[0], out[1], out[2], out[3]


def possible(words: np.ndarray, text: np.ndarray, exponent: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches in which the words of a run but for its last period lie.

    words: numbers of the words of several texts, text: the text of each, ascending.
    """
    order = np.argsort(words, kind="stable")
    same = (words[order[1:]] == words[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    distance = np.full(len(words), FAR)
    distance[order[:-1][same]] = (order[1:] - order[:-1])[same]
    least = -(-length * (exponent - 1) // exponent)
    at = np.flatnonzero(distance < FAR)
    while len(at):
        starts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])])
        sizes = np.diff(np.r_[starts, len(at)])
        stays = distance[at] <= np.repeat(np.where(sizes >= least, sizes // (exponent - 1), 0), sizes)
        if stays.all():
            return at[starts], at[starts] + sizes
        at = at[stays]
    return at, at


def find(words: np.ndarray, sizes: np.ndarray, exponent: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of several texts, as places in all words one behind the other, ascending.

    words: numbers of the words, sizes: how many of them each text has.
    """
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    lows, highs = possible(words, text, exponent, length)
    out, first = [np.zeros((3, 0), np.int64)], 0
    longest = (highs - lows) // (exponent - 1)
    stops = np.minimum(highs + longest + 1, ends[text[lows]]) if len(lows) else highs
    total = np.cumsum(stops - lows)
    while first < len(lows):
        done = total[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(total, done + TOGETHER, "right")))
        part = slice(first, after)
        stretches = [np.unique(words[a:b], return_inverse=True)[1] + 1 for a, b in zip(lows[part], stops[part], strict=True)]
        own, start, end, period = runs_of([x.tolist() for x in stretches])
        # What ends in the last period of this stretch or has a longer one belongs to another stretch.
        low, high = lows[part][own], highs[part][own]
        start, end = start + low, end + low
        good = (period <= longest[part][own]) & (end - period <= high) & (end - start >= np.maximum(length, exponent * period))
        out.append(np.stack([start[good], end[good], period[good]]))
        first = after
    found = np.concatenate(out, axis=1)
    return tuple(found[:, np.lexsort((found[2], found[0]))])


def periodic_runs(df: DataFrame, text: str = "text", exponent: int = 4, length: int = 6, key: str | None = None, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``df`` and n_words long, runs array<struct<start, length, period>>, collapsed string; input columns of these names are replaced.

    runs: those of ``exponent`` periods (2 or more) and ``length`` words at least,
    by start and period; places are numbers of words from 0 on.  collapsed: the
    words that no run holds behind its first period, joined by single spaces.
    ``rewrite`` may change the words of a row, given its ``key``.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    new = [T.StructField("n_words", T.LongType(), False), T.StructField("runs", RUNS, False), T.StructField("collapsed", T.StringType(), False)]
    df = df.drop(*(f.name for f in new))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, text):
            rows = [(x or b"").split() for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
            if rewrite:
                rows = [rewrite(k, words) for k, words in zip(batch.column(key).to_pylist(), rows, strict=True)]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            ends = np.cumsum(sizes)
            flat = [w for words in rows for w in words]
            start, end, period = find(np.asarray(pa.array(flat, pa.large_binary()).dictionary_encode().indices), sizes, exponent, length)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, end, -1)
            dropped = np.cumsum(edge[:-1]) > 0
            row = np.searchsorted(ends, start, "right")
            for r in np.unique(row).tolist():
                stays = ~dropped[ends[r] - sizes[r] : ends[r]]
                rows[r] = [w for w, s in zip(rows[r], stays.tolist(), strict=True) if s]
            begin = (ends - sizes)[row]
            kind = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
            items = pa.StructArray.from_arrays([pa.array(start - begin), pa.array(end - start), pa.array(period)], fields=list(kind))
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(rows)))]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=pa.list_(pa.field("element", kind, False)))
            collapsed = pa.array([b" ".join(words) for words in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), runs, collapsed], [*batch.schema.names, *(f.name for f in new)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract's documents: in one of ten the words from some place on come again and again (null ids: as they are)."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, key="doc_id", rewrite=repeat_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("smaller"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    period = -longest["smaller"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-longest["before"]).alias("start"),
        longest["length"].alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * longest["length"] / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
