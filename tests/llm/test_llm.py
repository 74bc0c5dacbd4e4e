"""The training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import bpe, jaccard, language, packing, quality_model, quality_rules, registry, substring_dedup, token_files, top_k, toxicity
from chalkline.llm.common import shared_dir
from chalkline.llm.components import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL_SF = os.environ.get("TEST_MODEL_DIR", "/root/testdata/sf0.01")  # sf0.001 holds out too few rows to judge a model by
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"word{i} the {i * i % 97}" for i in range(120))
ODD = [
    (None, "null id", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, PROSE, "en", "s", 1), (4, PROSE, "en", "s", 1), (5, PROSE, "en", "s", 1), (6, PROSE + " end", "de", "t", 1),
    (7, "ÉÈ ñ 世界 🙂 don't  x\n\ny", "fr", None, 9), (8, (PROSE + "\n") * 60, "en", "s", 1), (9, "x" * 3_000, "es", "u", 1), (10, "Menu | Home | About | Contact | Login\n" + PROSE, "en", "v", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


def test_encode_as_the_reference_libraries(spark, odd, vocabularies):
    import base64

    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clashing = odd.withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    out = bpe.decode(bpe.encode(clashing, path, vocabularies.PATTERN), path).collect()
    assert len(out) == len(ODD)
    for r in out:
        text = r.text or ""
        assert r.ids == other.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        data = text.encode()
        lengths = np.cumsum([0, *(len(other.decode_single_token_bytes(i)) for i in r.ids)])[:-1]
        assert r.offsets == [sum(b & 0xC0 != 0x80 for b in data[: at + 1]) - 1 for at in lengths]


def test_encode_fuzz(vocabularies):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    other, own = Tokenizer.from_file(path), bpe.encoder(path, vocabularies.PATTERN)
    rng, parts = np.random.default_rng(0), [" ", " ", "  ", "\n", "\t", " ", "'s", "'", "the", "12", "é", "!!", "x.", "\n\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert own(text).tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_as_the_library_finds_them(spark, vocabularies):
    from tokenizers import Tokenizer

    path, pattern = vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN
    other, own = Tokenizer.from_file(path), bpe.encoder(path, pattern)
    rng, parts = np.random.default_rng(1), [" ", "  ", "\n", "'s", "the", "12", "é", "x.", "<|endoftext|>", "<|endoftext|>", "<|endof", "|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000))]
    for text in texts:
        assert own(text).tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)
    rows = list(enumerate(texts[:60]))
    folder = f"{shared_dir(spark)}/files-added"
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern, 2, folder)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_files(spark, folder).collect()}
    assert got == {i: [*other.encode(t, add_special_tokens=False).ids, 2] for i, t in rows}
    back = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern), path).collect()
    assert all(bytes(r.decoded).decode() == r.text for r in back)


def test_huffman_is_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    free, limited = token_files.code_lengths(counts, 16), token_files.code_lengths(counts, 5)
    import heapq

    heap = sorted(int(c) for c in counts if c)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (free * counts).sum() == cost and limited.max() <= 5
    assert sum(2.0**-x for x in limited if x) <= 1 and token_files.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def test_a_repeated_id_fills_several_files(spark, vocabularies):
    path, pattern = vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN
    rows = [(i if i % 3 else 50 if i % 2 else None, f"text number {i}") for i in range(400)]
    folder = f"{shared_dir(spark)}/files-hot"
    token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string"), path, pattern, 2, folder, file_ids=150)
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/records").groupBy("file").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 100
    got = token_files.read_files(spark, folder).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    own = bpe.encoder(path, pattern)
    assert Counter((i, np.frombuffer(r.ids, "<u4").tobytes()) for i, r in zip(ids, got, strict=True)) == Counter((-1 if d is None else d, np.append(own(t), 2).astype("<u4").tobytes()) for d, t in rows)


def test_token_files_round_trip(spark, odd, empty, vocabularies):
    path, pattern = vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN
    own = bpe.Encoder(path, pattern)
    folder = f"{shared_dir(spark)}/files-test"
    token_files.write_files(odd, path, pattern, 2, folder, file_ids=5_000)
    got = token_files.read_files(spark, folder).orderBy("start").collect()
    want = sorted(((-1 if d is None else d, [*own(t).tolist(), 2]) for d, t, *_ in ODD), key=lambda x: (x[0], len(x[1])))
    assert [(-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    token_files.write_files(empty, path, pattern, 2, folder + "-empty")
    assert token_files.read_files(spark, folder + "-empty").count() == 0


def plain_rules(text):
    import re

    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(i + j for i in places for j in range(8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_python(spark, odd, empty):
    rows = quality_rules.judge(odd.withColumn("kept", F.lit(1))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(r.text or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].kept and by_id[10].kept and "Menu" not in by_id[10].cleaned_text and not by_id[8].kept and by_id[1].cleaned_text is None
    assert quality_rules.judge(empty).count() == 0


def test_punctuation_and_navigation_lines_go(spark):
    bad = [".....!!!!!-----.....", "Products | Our Prices | Contact", "News » Local » Sport » More", "Login"]
    good = ["He said: \"Well, well - let's go!\"", "The choice is A | B, as every reader of this long line will know | or so we hope to see", "One line with enough ordinary words."]
    rows = [(1, "\n".join([PROSE, *bad, *good]))]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got.cleaned_text.split("\n") == [PROSE, *good] and got.kept


def test_caseless_lines_with_an_acronym_stay(spark):
    clean = "".join(f"هذا سطر عربي رقم {i} عن DNA وعن ورق A4 في المدرسة\n" for i in range(30))
    rows = [(1, clean), (2, PROSE + "\nALL IN CAPITALS, 1 LINE OF IT"), (3, PROSE + "\n中文 THIS IS LOUD AND LONG")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_chars == got[1].line_chars and "DNA" in got[1].cleaned_text
    assert got[2].cleaned_text == got[3].cleaned_text == PROSE


def grams(text, n):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


@pytest.mark.parametrize("s", [jaccard.Similarity(3, 90), jaccard.Similarity(1, 60)])
def test_jaccard_against_all_pairs(spark, s, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)  # so that tiles are cut into blocks
    rng = np.random.default_rng(s.percent)
    base = [[f"w{rng.integers(0, 400)}" for _ in range(rng.integers(1, 90))] for _ in range(25)]
    texts = []
    for words in base:
        for _ in range(rng.integers(1, 9)):
            copy = list(words)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, len(copy))] = f"w{rng.integers(0, 400)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "ONE", " one ", "one two"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    sets = {i: grams(t, s.words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= s.percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), find(i)) for i in sets)


def test_jaccard_odd_inputs(spark, odd, empty):
    got = jaccard.join_components(odd.withColumn("component_id", F.lit("x")), jaccard.Similarity()).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 4), (7, 7), (8, 4), (9, 9), (10, 4)])
    assert jaccard.join_components(empty).count() == 0


def test_jaccard_rows_of_tiles_are_shuffled_once(spark):
    """Rows alone in their tile go, and tiles of guests alone, without a second shuffle for a join."""
    sets = [(0, 20, [1, 2, 3]), (1, 20, [3, 4]), (2, 30, [7, 8]), (3, 30, [7, 8]), (4, 33, [7])]
    got = jaccard.tile_rows(spark.createDataFrame(sets, "key long, n long, prefix array<long>"), jaccard.Similarity(3, 90))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.key, r.n, r.guest) for r in got.collect()) == [(0, 20, False), (1, 20, False), *((k, 30, g) for k in (2, 3) for g in (False, False, True)), (4, 33, False)]


def test_jaccard_ships_texts_of_near_pairs_alone(spark, monkeypatch):
    """Sets that meet in tiles are compared by bitmaps; the texts of those ruled out are neither kept nor shuffled."""
    words = [f"w{i}" for i in range(2_000)]
    rows = [(i, " ".join(words[:130] + words[200 + 30 * i : 230 + 30 * i])) for i in range(1, 13)]  # two thirds in common
    near, other = " ".join(words[800:1_000]), " ".join(words[1_100:1_300])
    rows += [(20, near), (20, other), (21, near + " end"), (22, other + " end"), (22, other + " end"), (23, None)]  # 20 has two texts
    tables = []

    def recorded(df, name, *more, **named):
        tables.append((name, write(df, name, *more, **named)))
        if name in ("candidates", "asked"):
            tables[-1] += (tables[-1][1].collect(),)  # before the folder is removed
        return tables[-1][1]

    write = jaccard.write_table
    monkeypatch.setattr(jaccard, "write_table", recorded)
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Similarity(3, 90)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [*((i, i) for i in range(1, 13)), (20, 20), (20, 20), (21, 20), (22, 20), (22, 20), (23, 23)]
    (candidates,) = [t[1:] for t in tables if t[0] == "candidates"]
    assert candidates[0].columns == ["key", "n", "bits"] and len(candidates[1]) == 16
    assert {r["first"] for t in tables if t[0] == "asked" for r in t[2]} == {20, 21, 22}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_substring_dedup_against_plain_python(spark, odd, empty):
    s = substring_dedup.Settings()
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"{rng.integers(0, 10**6):x}é" for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(80) + (" " + shared + " " if i % 4 == 0 else " ") + prose(80)) for i in range(40)] + [(50, shared + " " + shared), (51, "y" * 3000)]
    got = {r.doc_id: r for r in substring_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = set()
    for i, text in rows:
        data = text.encode()
        ends = substring_dedup.chunk_ends(data, s)
        assert b"".join(data[a:b] for a, b in zip([0, *ends], ends, strict=False)) == data and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= s.max_chunk
        places = []
        for a, b in zip([0, *ends], ends, strict=False):
            if data[a:b] in seen:
                places.append(a << 10 | b - a)
            seen.add(data[a:b])
        spans = substring_dedup.runs(places, s.min_bytes)
        assert [(x.start, x.end) for x in got[i].removed_spans] == spans
        assert got[i].removed_bytes == sum(b - a for a, b in spans) == len(data) - len(got[i].text.encode())
    assert all((got[i].removed_bytes > 0) == (i % 4 == 0 and i > 0) for i in range(40))
    out = substring_dedup.dedupe(odd).collect()
    assert len(out) == len(ODD) and Counter(r.text for r in out if r.doc_id == 4) == {PROSE: 2}
    assert next(r for r in out if r.doc_id == 5).removed_bytes > 0 and next(r for r in out if r.doc_id is None).text == "null id"
    assert substring_dedup.dedupe(empty).count() == 0


def test_chunks_against_the_rolling_hash():
    """Cuts by definition: the hash of the last 16 bytes at each place, one byte at a time."""
    s, rng = substring_dedup.Settings(), np.random.default_rng(13)
    parts = ["word ", "a\tb\n", "é", "世界人民", "z" * 300, "x" * 700, "mixed Case, text; ", "0" * 90 + " "]
    for _ in range(60):
        data = "".join(rng.choice(parts, rng.integers(0, 60))).encode()
        spaces = [-1, *(i for i, b in enumerate(data) if b in b" \t\n\x0b\x0c\r"), len(data)]
        stretch = {i: y - x for x, y in zip(spaces, spaces[1:], strict=False) for i in range(x + 1, y + 1)}
        ends, last = [], 0
        for i in range(len(data)):
            h = sum(int(substring_dedup.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) % (1 << 32) >> 24
            at_space = data[i] in b" \t\n\x0b\x0c\r" and h < s.cut_share
            whole = i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80
            in_long = stretch[i] > s.min_bytes and whole and h < s.unspaced_share
            cut = i + 1
            if not (at_space or in_long or cut == len(data)):
                continue
            while cut - last > s.max_chunk:
                forced = last + s.max_chunk
                while data[forced] & 0xC0 == 0x80:
                    forced -= 1
                ends.append(forced)
                last = forced
            if cut - last >= s.min_chunk or cut == len(data) > last:
                ends.append(cut)
                last = cut
        assert substring_dedup.chunk_ends(data, s) == ends


def test_one_character_before_unspaced_text(spark):
    rng = np.random.default_rng(14)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 4000)))
    got = {r.doc_id: r for r in substring_dedup.dedupe(spark.createDataFrame([(1, text), (2, "一" + text)], "doc_id long, text string")).collect()}
    assert got[1].removed_bytes == 0 and got[2].removed_bytes > 0.9 * len(text.encode())


def test_known_phrases_in_a_new_order_stay(spark):
    s = substring_dedup.Settings()
    rng = np.random.default_rng(6)
    prose = " ".join(f"{rng.integers(0, 10**6)}" for _ in range(3000))
    ends = substring_dedup.chunk_ends(prose.encode(), s)
    chunks = [prose[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    phrases = [c for c in chunks[1:-1] if 16 <= len(c) < s.min_bytes][:120]  # each is a chunk after whatever ends as its neighbour did
    known, mixed = "".join(chunks), "".join(phrases[i] for i in rng.permutation(len(phrases)))
    got = {r.doc_id: r for r in substring_dedup.dedupe(spark.createDataFrame([(1, known), (2, mixed), (3, "start " + mixed)], "doc_id long, text string")).collect()}
    ends = substring_dedup.chunk_ends(mixed.encode(), s)
    again, run, longest = set(chunks), 0, 0
    for a, b in zip([0, *ends], ends, strict=False):
        run = run + b - a if mixed[a:b] in again else 0
        longest = max(longest, run)
    assert longest >= s.min_bytes  # chunks known singly do make long runs
    assert got[1].removed_bytes == 0 and got[2].text == mixed and got[3].removed_bytes > 0.9 * len(mixed)


def test_spans_cover_every_long_passage():
    s, rng = substring_dedup.Settings(), np.random.default_rng(7)
    for _ in range(200):
        ends = np.cumsum(rng.integers(1, 140, rng.integers(0, 9)))
        bounds = [0, *ends.tolist()]
        first, last = substring_dedup.spans_of(ends, s)
        spans = [(bounds[i], bounds[j + 1]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        assert all(y - x >= s.min_bytes and x in bounds and y in bounds for x, y in spans)
        for i, x in enumerate(bounds):
            for y in bounds[i + 1 :]:
                if y - x >= s.min_bytes:
                    inside = {k for p, q in spans if x <= p and q <= y for k in range(p, q)}
                    assert inside == set(range(x, y))


def test_shared_passage_without_spaces_at_any_offset(spark):
    rng = np.random.default_rng(8)
    text = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))
    shared = text(700)
    rows = [(i, text(101 + 7 * i) + shared + text(150)) for i in range(12)] + [(20, text(900))]
    got = {r.doc_id: r for r in substring_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].removed_bytes == got[20].removed_bytes == 0
    for i, value in rows[1:12]:
        at, size = len(value[: 101 + 7 * i].encode()), len(shared.encode())
        inside = sum(max(0, min(x.end, at + size) - max(x.start, at)) for x in got[i].removed_spans)
        assert inside == got[i].removed_bytes >= 0.7 * size


def test_scores_beyond_64_bits_are_an_error():
    index = top_k.Index(np.arange(3), np.full((3, 2), 1 << 40))
    with pytest.raises(OverflowError):
        index.search(np.full(2, 1 << 40), 0, 1, -np.inf)
    wide = np.array([[1 << 40, -(1 << 40)], [1 << 40, 3 - (1 << 40)], [-(1 << 40), 1], [5, 6]])  # bounds beyond 64 bits, best scores within
    for query in ((1 << 40, 1 << 40), (2, 1)):
        best = sorted(((i, sum(int(a) * b for a, b in zip(v, query, strict=True))) for i, v in enumerate(wide)), key=lambda x: (-x[1], x[0]))[:2]
        found, scores = top_k.Index(np.arange(4), wide).search(np.array(query), 99, 2, -np.inf)
        assert list(zip(found.tolist(), scores.tolist(), strict=True)) == best
    big = np.random.default_rng(16).integers(-(1 << 28), 1 << 28, (500, 8))  # scores beyond 53 bits
    found, scores = top_k.Index(np.arange(500), big).search(big[3], 3, 5, -np.inf)
    full = sorted(((j, sum(int(a) * int(b) for a, b in zip(big[j], big[3], strict=True))) for j in range(500) if j != 3), key=lambda p: (-p[1], p[0]))[:5]
    assert list(zip(found.tolist(), scores.tolist(), strict=True)) == full


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (400, 16))
    x[100:180] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 16), (650, [float("inf")] * 16), (None, [1.0] * 16), (700, [0.5] * 3), (750, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    good = {i: np.floor(256 * np.pad(np.array(v, float), (0, 16 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    got = defaultdict(list)
    for r in top_k.top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        assert found == sorted(((i, int(good[q] @ v)) for i, v in good.items() if i != q), key=lambda p: (-p[1], p[0]))[:5]
    assert top_k.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(4)
    x = rng.integers(-90, 90, (3000, 24))
    index = top_k.Index(np.arange(3000), x)
    for i in range(0, 3000, 300):
        found, scores = index.search(x[i], i, 5, -np.inf)
        full = [(j, int(x[j] @ x[i])) for j in range(3000) if j != i]
        assert list(zip(found.tolist(), scores.tolist(), strict=True)) == sorted(full, key=lambda p: (-p[1], p[0]))[:5]


def check_packing(rows, docs, capacity):
    lengths, bins = Counter(), defaultdict(list)
    for r in rows:
        lengths[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert lengths == Counter({k: v for k, (v, _, _) in docs.items()}) or all(lengths[k] == v for k, (v, _, _) in docs.items())
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist() and sum(p.length for p in pieces) <= capacity
        for n in (1, 2):
            known = [docs[p.doc_id][n] for p in pieces if docs[p.doc_id][n] is not None]
            assert len(known) == len(set(known))


def test_packing(spark, odd, empty):
    rows = [(i, " ".join(["w"] * (i * 37 % 160)), f"s{min(i % 9, 5)}") for i in range(300)] + [(900, None, None), (901, "x " * 500, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin_id", F.lit(0))
    docs = {r.doc_id: (r.n, r.source, r.c) for r in df.select("doc_id", packing.n_words().alias("n"), "source", packing.text_cluster().alias("c")).collect()}
    check_packing(packing.pack(df, 128).collect(), docs, 128)
    assert packing.best_fit([5, 4, 3, 1, 1], ["a", "b", "a", "b", "c"], [1, 2, 3, 4, 5], 8) == [(0, 0), (1, 0), (1, 4), (0, 5), (1, 7)]
    out = packing.pack(odd, 64).collect()
    assert {r.doc_id for r in out} == {d for d, *_ in ODD} and packing.pack(empty, 64).count() == 0


def test_packing_against_plain_best_fit(spark):
    """Every bin is looked at for every piece; one shard."""
    rng = np.random.default_rng(15)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 90)) + [f"x{i % 40}"]), f"s{rng.integers(0, 30)}") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = df.select("doc_id", packing.n_words().alias("n"), "source", packing.text_cluster().cast("string").alias("c")).collect()
    pieces = sorted(((min(64, r.n - at), r.doc_id, at // 64, r.source, r.c) for r in known for at in range(0, r.n, 64)), key=lambda p: (-p[0], p[1], p[2]))
    bins, want = [], {}
    for n, doc, piece, source, cluster in pieces:
        fits = [(left, k) for k, (left, sources, clusters) in enumerate(bins) if left >= n and source not in sources and cluster not in clusters]
        if not fits:
            bins.append([64, set(), set()])
            fits = [(64, len(bins) - 1)]
        left, k = min(fits)
        want[doc, piece] = (f"0-{k}", 64 - left)
        bins[k] = [left - n, bins[k][1] | {source}, bins[k][2] | {cluster}]
    assert {(r.doc_id, r.piece): (r.bin_id, r.offset) for r in packing.pack(df, 64).collect()} == want


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the given tables")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


def auc(scores, labels):
    """The share of pairs of a positive and a negative that are in order, ties half."""
    scores, labels = np.asarray(scores, float), np.asarray(labels, bool)
    a, b = scores[labels][:, None], scores[~labels][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.mark.skipif(not os.path.isdir(MODEL_SF), reason="needs the given tables")
def test_models_on_held_out_rows(spark):
    """Only rows that no model was fitted on count; accuracy must beat the commonest answer."""
    labels = {r.doc_id: r for r in spark.read.parquet(f"{MODEL_SF}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MODEL_SF}/documents.parquet").select("doc_id", "lang").collect()}
    good = registry.QUERIES["op4_quality_classifier"](spark, MODEL_SF).collect()
    assert len(good) == len(langs) and all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in good)
    out = [r for r in good if r.held_out and r.doc_id in labels]
    truth = [labels[r.doc_id].quality for r in out]
    majority = max(np.mean(truth), 1 - np.mean(truth))
    assert auc([r.score for r in out], truth) >= 0.95 and np.mean([r.predicted == t for r, t in zip(out, truth, strict=True)]) > majority + 0.05
    bad = registry.QUERIES["op5_toxicity"](spark, MODEL_SF).collect()
    out = [r for r in bad if held(r.doc_id, 5) == 0 and r.doc_id in labels]
    truth = [labels[r.doc_id].toxic for r in out]
    assert 0 < sum(truth) < len(truth) and auc([r.severity for r in out], truth) >= 0.75
    assert np.mean([r.predicted == t for r, t in zip(out, truth, strict=True)]) >= 1 - np.mean(truth)
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade >= 1) for r in bad)
    lang = registry.QUERIES["op10_language_id"](spark, MODEL_SF).collect()
    out = [r for r in lang if r.held_out and langs[r.doc_id] is not None]
    majority = Counter(langs[r.doc_id] for r in out).most_common(1)[0][1] / len(out)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in out]) >= max(0.95, majority + 0.1)


def test_ftrl_against_dense_updates():
    """The textbook update of every coordinate, row by row."""
    s = quality_model.Settings(bits=5, epochs=3)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(40):
        i = np.sort(rng.choice(32, 6, replace=False))
        rows.append((i, rng.random(6), int(rng.integers(0, 2))))
    w, bias = quality_model.fit_ftrl(rows, s)
    z, n = [0.0] * 33, [0.0] * 33

    def weight(j):
        return 0.0 if abs(z[j]) <= s.l1 else -(z[j] - np.sign(z[j]) * s.l1) / ((s.beta + n[j] ** 0.5) / s.alpha + s.l2)

    for epoch in range(s.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x, y = rows[k]
            dense = np.zeros(33)
            dense[i], dense[32] = x, 1
            now = [weight(j) for j in range(33)]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(now, dense, strict=True))))
            for j in np.flatnonzero(dense):
                g = (p - y) * dense[j]
                sigma = ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / s.alpha
                z[j] += g - sigma * now[j]
                n[j] += g * g
    assert np.allclose([*w, bias], [weight(j) for j in range(33)])


def test_quality_score_is_the_sparse_dot_product(spark, odd):
    s = quality_model.Settings(bits=10)
    weights = np.random.default_rng(10).normal(0, 1, 1025)
    for r in quality_model.score(odd, weights, s).collect():
        counts = Counter(quality_model.features(r.text, s.bits).tolist())
        total = sum(counts.values())
        dot = sum(weights[i] * s.scale * n / total for i, n in counts.items()) + weights[-1]
        assert abs(r.score - 1 / (1 + np.exp(-dot))) < 1e-9


def test_ordinal_fit_against_dense_descent():
    s, rng = toxicity.Settings(steps=60), np.random.default_rng(11)
    x = rng.integers(0, 3, (80, 7)) * rng.random((80, 7))
    grade = np.minimum(3, (x[:, 0] > 0.4) + 2 * (x[:, 1] > 0.9))
    row, i = np.nonzero(x)
    got = toxicity.fit_ordinal(row, i, x[row, i], 7, grade, s)
    theta, speed = np.array([0.0] * 7 + [2.0, 0.0, 0.0]), np.zeros(10)
    part = np.where(grade == 0, 0.5 / (grade == 0).sum(), 0.5 / (grade > 0).sum())

    def loss(v):  # of all thresholds, so that its slope can be taken by differences
        t = v[7] + np.array([0.0, np.exp(v[8]), np.exp(v[8]) + np.exp(v[9])])
        off = (x @ v[:7])[:, None] - t
        above = grade[:, None] >= np.arange(1, 4)
        return ((np.log1p(np.exp(off)) - above * off) * part[:, None]).sum() + s.l2 / 2 * (v[:7] ** 2).sum()

    for _ in range(s.steps):
        slope = np.array([(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(10) * 1e-5])
        speed = 0.9 * speed - s.rate * slope
        theta = theta + speed
    want = [*theta[:7], *(theta[7] + np.array([0.0, np.exp(theta[8]), np.exp(theta[8]) + np.exp(theta[9])]))]
    assert np.allclose(got, want, atol=1e-4)


def test_language_scores_against_the_whole_kernel(spark):
    """With every training text a landmark, the answers are those of kernel ridge regression over all pairs."""
    rng = np.random.default_rng(12)
    alphabet = {"aa": "abcdefg ", "bb": "efghijk ", "cc": "qrstuvw "}
    rows = [(i, "".join(rng.choice(list(alphabet[lang]), 30)), lang) for i, lang in enumerate(("aa", "bb", "cc") * 8)]
    train, test = rows[:18], rows[18:]
    schema = "doc_id long, text string, lang string"
    s = language.Settings(landmarks=18)
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(test, schema).drop("lang"), language.train(spark.createDataFrame(train, schema), s)).collect()}
    cells = {i: set(language.spectrum(t).tolist()) for i, t, _ in rows}
    kernel = lambda a, b: len(cells[a] & cells[b]) / (len(cells[a]) * len(cells[b])) ** 0.5
    k = np.array([[kernel(a[0], b[0]) for b in train] for a in train])
    y = np.array([[float(lang == n) for n in sorted(alphabet)] for _, _, lang in train])
    alpha = np.linalg.solve(k + s.ridge / 3 * 6 * np.eye(18), y)  # six rows a language weigh one sixth each
    for i, _, _ in test:
        want = np.array([kernel(i, b[0]) for b in train]) @ alpha
        assert got[i].lang_pred == sorted(alphabet)[want.argmax()] and abs(got[i].score - np.clip(want.max(), 0, 1)) < 1e-3


def test_every_language_is_learned(spark):
    rows = [(10 * i + j, chr(0x4E00 + 40 * i) * 12 + f"{j}", f"l{i:03}") for i in range(230) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.languages) == 230 and len(model.landmarks) == 230
    assert np.mean([r.lang_pred == r.lang for r in language.predict(df, model).collect()]) > 0.9


def test_samples_are_bounded_and_whole_below_the_bound(spark):
    from chalkline.llm.samples import labelled_sample

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    docs = docs.union(spark.range(5000).select(F.lit(7).cast("long"), F.concat(F.lit("u"), F.col("id").cast("string"))))  # one id many times
    labels = spark.range(-1, 7000).select(F.when(F.col("id") >= 0, F.col("id")).alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = labelled_sample(docs, labels, "y", 2000, F.col("doc_id") < 5).collect()
    by = Counter(r.y for r in got)
    assert by[1] == 599 and 650 <= by[0] <= 1000 and len({r.doc_id for r in got}) == len(got)


def test_models_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality_model.quality_scores(odd.withColumn("score", F.lit("x")), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    nothing = quality_model.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5} and quality_model.quality_scores(empty, labels).count() == 0
    assert toxicity.fit(odd.select("doc_id", "text", F.lit(0).alias("toxic")))[0] == {}
    assert not any(r.toxic for r in toxicity.score(odd, *toxicity.fit(odd.select("doc_id", "text", F.lit(0).alias("toxic")))).collect())
    model = language.train(odd)
    pred = {r.doc_id: r.lang_pred for r in language.predict(odd.drop("lang").withColumn("score", F.lit(1)), model).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[7] == "fr"
    assert {r.lang_pred for r in language.predict(odd, language.train(empty)).collect()} == {"und"}


def test_severity_grows_with_the_grade():
    rng = np.random.default_rng(5)
    n = rng.integers(0, 7, 400)
    x = np.log1p(np.stack([n, rng.integers(0, 2, 400)], 1)).astype(float)
    grade = np.where(n == 0, 0, 1 + (n >= 2) + (n >= 4))
    row, i = np.nonzero(x)
    w = toxicity.fit_ordinal(row, i, x[row, i], 2, grade, toxicity.Settings())
    t = w[-3:]
    assert t[0] <= t[1] <= t[2]
    severity = (1 / (1 + np.exp(-(x @ w[:-3])[:, None] + t))).sum(1)
    means = [severity[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and ((severity >= 0.5) == (grade > 0)).mean() > 0.9


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(found.fetchall())


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as p

    docs = tables[0]
    for i, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if i == len(p.STAGES) - 1:
            check_packing(rows, {r.doc_id: (r.n, r.source, r.c) for r in docs.select("doc_id", packing.n_words().alias("n"), "source", packing.text_cluster().alias("c")).collect()}, p.CAPACITY)
            break
        assert out.columns == p.COLUMNS and {r.doc_id for r in rows} <= set(before)
        after = {r.doc_id: r.text for r in rows}
        if name == "n-gram Jaccard join":
            ids, sets = sorted(before), {d: grams(t, 5) for d, t in before.items()}
            for a in ids:
                for b in ids:
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        assert b not in after
            assert all(after[d] == before[d] for d in after)
        if name == "quality classifier":
            assert all(after[d] == before[d] for d in after)
        docs = out
    assert p.run(spark, SF).count() == len(rows)


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, an id with two texts, no rows: every stage ends with defined rows."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, 1, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(6, "another text of the same id " + PROSE[::-1], "de", "t", 1), (30, "long " * 200_000, "en", "s", 1)], DOCS)
    docs = odd.union(two).withColumn("extra", F.lit(1)).withColumn("score", F.lit("clash"))
    for name, rows in (("odd", docs), ("empty", empty)):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        found, kept = p.run(spark, folder).collect(), rows
        for _, stage in p.STAGES[:-1]:  # run() gives what its stages give one after another
            kept = stage(spark, kept, folder).cache()
        check_packing(found, {r.doc_id: (r.n, r.source, r.c) for r in kept.select("doc_id", packing.n_words().alias("n"), "source", packing.text_cluster().alias("c")).collect()}, p.CAPACITY)
        if name == "empty":
            assert not found
    alone = docs.select(p.COLUMNS)
    kept = p.near_duplicates(spark, alone, "").collect()
    texts = Counter((r.doc_id, r.text) for r in kept)
    assert texts[4, PROSE] == 1 and (5, PROSE) not in texts and texts[None, "null id"] == 1 and texts[1, None] == texts[2, ""] == 1
    assert not {r.text for r in kept if r.doc_id == 6}  # one component with 4, through its first text
    ruled = p.rules(spark, docs, "").collect()
    assert all(r.text is not None and r.n_chars == len(r.text) for r in ruled)
    for stage in (p.near_duplicates, p.rules, p.repeated_passages, p.best_fit):
        assert stage(spark, alone.limit(0), "").count() == 0


def test_sha_columns(spark, tables):
    row = registry.QUERIES["op2_bpe_round_trip"](spark, SF).where("doc_id = 0").first()
    text = tables[0].where("doc_id = 0").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
