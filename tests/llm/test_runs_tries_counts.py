"""Periodic runs, prefix trie and token counts against brute force, SQL and the library itself."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import periodic_runs, prefix_trie, token_counts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACES = " \t\n\x0b\x0c\r"


def all_runs(words, exponent=4, length=6):
    """Every (start, end, period), each period tried at each place."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(length, exponent * q) and not smaller:
                out.append((start, end, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    for space in SPACES:
        text = (text or "").replace(space, " ")
    return [w for w in text.split(" ") if w]


@pytest.mark.parametrize(("exponent", "length"), [(4, 6), (2, 2), (3, 9)])
def test_runs_of_random_words(exponent, length):
    rng = random.Random(exponent)
    for _ in range(400):
        alphabet = rng.choice([1, 2, 3, 20])
        texts = [[x for _ in range(rng.randrange(6)) for x in [rng.randrange(alphabet) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 8)] for _ in range(rng.randrange(1, 4))]
        sizes = np.array([len(t) for t in texts])
        got = list(zip(*(x.tolist() for x in periodic_runs.find(np.array([x for t in texts for x in t], np.int64), sizes, exponent, length)), strict=True))
        begin = np.cumsum(sizes) - sizes
        assert got == [(a + s, a + e, q) for a, t in zip(begin.tolist(), texts, strict=True) for s, e, q in all_runs(t, exponent, length)]


def test_suffix_tree_as_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(40))] + [0]
        leaves, depths = periodic_runs.euler_tour(s)
        assert leaves == sorted(range(len(s)), key=lambda i: s[i:])
        shared = lambda a, b: next(k for k in range(len(s)) if s[a + k] != s[b + k])
        assert depths == [0, *(shared(a, b) for a, b in zip(leaves, leaves[1:], strict=False))]


RUN_TEXTS = [None, "", " \n\t", "a", "la " * 40, "ab cd " * 9 + "x y", "no run in here at all", "x y " * 8, "é ü " * 3 + "z " * 5 + "é ü " * 7, "one\x0btwo\x0cthree\r\n" * 6, "w " * 3 + "v w " * 12]


def test_op11_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, t) for i, t in enumerate(RUN_TEXTS)] * 2 + [(None, "b " * 9), (None, None)]
    rows += [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(120)))) for i in range(100, 500)]
    rows.append((-(1 << 62), "p q r " * 2_000 + "end"))
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    monkeypatch.setattr(periodic_runs, "read", lambda *_: df)
    got = sorted((tuple(r[:8]) for r in periodic_runs.op11_periodic_runs(spark, "").collect()), key=repr)
    want = []
    for i, t in rows:
        words, h = split(t), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = all_runs(words) if n < 5_000 else [(0, 6_000, 3)]
        gone = {k for s, e, q in runs for k in range(s + q, e)}
        s, e, q = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=(None,) * 3)
        best = (s, e - s, q, 1000 * (e - s) // q) if runs else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=repr) and sum(r[1] > 0 for r in got) > 20


def test_runs_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 4, "x"), (1, "a b " * 4, "x"), (2, None, None)], "id int, body string, collapsed string")
    rows = periodic_runs.periodic_runs(df, "body").collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(8, [(0, 8, 2)], "a b")] * 2 + [(0, [], "")]
    assert periodic_runs.periodic_runs(df.limit(0), "body").collect() == []


def trie_by_hand(rows, rebuild=True):
    """Nodes as the contract says, from all conversations in memory."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in turns.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in turns.items()}
    members = defaultdict(list)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        under = [below(p) for p in children[path]]
        value = (len(members[path]) - 1) * len(split(path[-1][1])) if path else 0
        return value + sum(v for v, _ in under), sum(n for _, n in under) if under else 1

    out = []
    for path, own in members.items():
        saved, leaves = below(path)
        here = ",".join(map(str, sorted(c for c in own if len(turns[c]) == len(path))))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]), leaves, saved, hashlib.sha256(here.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TALK = "conv_id long, turn int, role string, text string, words string, depth int"


def talk(rng, conversations):
    rows = []
    for c in range(conversations):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c if c % 30 else c + 20, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", None]), rng.choice(["hello there", "b c\nd", "", None]), "clash", 3))
    rows += [(7, 50 + t, "user", "long one", None, None) for t in range(40)] + [(8, 50 + t, "user", "long one", None, None) for t in range(40)]
    return rows + [rows[0]] * 3 + [(None, 1, "user", "nobody", None, None)]  # repeated rows, and one of no conversation


@pytest.mark.parametrize(("block", "widest"), [(1_024, 1 << 27), (2, 1 << 3)])
def test_trie_against_brute_force(spark, monkeypatch, block, widest):
    """With long conversations in many blocks, and a sketch so small that it proves next to nothing."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "WIDEST", widest)
    rows = talk(random.Random(block), 90)
    # Turns of one number are ordered by digest, so the brute force gets none of different content.
    first = {}
    rows = [r for r in rows if first.setdefault((r[0], r[1]), r[2:4]) == r[2:4]]
    df = spark.createDataFrame(rows, TALK)
    monkeypatch.setattr(prefix_trie, "read", lambda *_: df)
    got = prefix_trie.op12_prefix_trie(spark, "").collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=repr) == trie_by_hand(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}", None, None) for c in range(300) for t in range(4)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, TALK).repartition(7))
    whole = turns.where("position = 1").select("conv_id", "n_turns")
    got = prefix_trie.prefix_trie(turns, whole).collect()
    assert sorted((tuple(r[c] for c in NODE) for r in got), key=repr) == trie_by_hand(rows, rebuild=False)
    for n in (0, 1):  # an empty table, and a single conversation
        turns = prefix_trie.numbered(spark.createDataFrame(rows[:n], TALK))
        got = prefix_trie.prefix_trie(turns, turns.select("conv_id", "n_turns")).collect()
        assert sorted((tuple(r[c] for c in NODE) for r in got), key=repr) == trie_by_hand(rows[:n], rebuild=False)


def test_sketch_never_calls_a_shared_prefix_single(spark):
    rows = spark.range(5_000).select((F.col("id") % 4_000).alias("x"), F.xxhash64(F.col("id") % 4_000).alias("y"))
    rows = rows.withColumns({"px": F.lit(None).cast("long"), "py": F.lit(None).cast("long")})
    for width in (1 << 8, 1 << 16):
        got = prefix_trie.screened(rows.repartition(5), width).groupBy("x").agg(F.count("*").alias("n"), F.bool_or("shared").alias("shared")).collect()
        assert all(r.shared for r in got if r.n > 1) and (width < 1 << 16 or sum(r.shared for r in got) < 1_100)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_trie_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = con.execute(f"SELECT {', '.join(NODE)} FROM ({prefix_trie.TRIE_SQL})").fetchall()
    got = [tuple(r[c] for c in NODE) for r in prefix_trie.op12_prefix_trie(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "<|endoftext|>", "<|endoftext", "é", "世界", "🙂", "don't", "'s", "'", "12", "!?", " ", "　", "\x1c", "\x85", "\t", "x" * 30, "ing", "​", "_", "́", "Ⅷ"]


def odd_texts():
    rng = random.Random(13)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(4_000)]
    letters = ["".join(rng.choice("abcdefgh") for _ in range(5_000)), "".join(rng.choice("ab") for _ in range(3_000)), "x" * 4_001, "世界和平" * 600]
    return [*texts, *letters, None, "", " ", "plain words and more words " * 300]


def test_token_counts_as_the_library(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path, vocabularies.PATTERN).collect()}
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == {i: (len((t or "").encode()), len(e.ids)) for i, (t, e) in enumerate(zip(texts, want, strict=True))}
    assert token_counts.count_tokens(df.limit(0), path, vocabularies.PATTERN).collect() == []


def test_token_counts_of_rank_files(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path = vocabularies.path(name)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        other = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
        texts = odd_texts()
        got = token_counts.Counter(path, vocabularies.PATTERN)(pa.array(texts))
        assert got.tolist() == [len(other.encode_ordinary(t or "")) for t in texts]


def test_long_rows_merge_as_short_ones(monkeypatch):
    vocabularies = pytest.importorskip("public_tokenizers")
    rng = random.Random(3)
    pieces = ["".join(rng.choice("abcent ") for _ in range(rng.randrange(1, 200))).encode() for _ in range(300)]
    merges = token_counts.merges(vocabularies.path("byte_bpe_50k.json"))
    short = merges.counts(pieces).tolist()
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert merges.counts(pieces).tolist() == short


def test_vocabularies_that_are_not_supported():
    vocabularies = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Merges(vocabularies.path("word_bpe_49k.json"))


def test_op13_limit(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, " a" * 1_024), (2, " a" * 1_025), (None, None)], "doc_id long, text string")
    monkeypatch.setattr(token_counts, "read", lambda *_: df)
    got = [tuple(r) for r in token_counts.op13_token_counts(spark, "").collect()]
    assert got == [(1, 2_048, 1_024, False), (2, 2_050, 1_025, True), (None, 0, 0, False)]
