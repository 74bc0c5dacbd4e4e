"""Large, repeated and rare ids: file bounds, texts of one id, languages of few ids."""

import random
import zlib

import numpy as np
import pytest

from chalkline.llm import bpe, language, packing, substring_dedup, token_files


def test_token_files_of_large_ids(spark, tmp_path):
    """Ids a float can't tell apart, nulls, the least integer and an id of many rows: every start over several files."""
    vocabularies = pytest.importorskip("public_tokenizers")
    path, pattern, folder = vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, f"file://{tmp_path}/files"
    rng = random.Random(8)
    rows = [((1 << 62) + i, " ".join(["word"] * rng.randrange(1, 9))) for i in range(3_000)]
    rows += [(None, "null"), (None, None), (-(1 << 63), "least"), ((1 << 63) - 1, "most")] + [((1 << 62) + 7, "again and again")] * 900
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_files.write_files(df, path, pattern, 2, folder, file_ids=2_000)
    sizes = [r["count"] for r in spark.read.parquet(f"{folder}/records").groupBy("file").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1_500
    got = token_files.read_files(spark, folder).orderBy("start").collect()
    key = lambda i: -(1 << 63) if i is None else i
    ids = [key(r.doc_id) for r in got]
    own = bpe.encoder(path, pattern)
    assert ids == sorted(key(i) for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted((key(r.doc_id), r.n_tokens) for r in got) == sorted((key(i), len(own(t)) + 1) for i, t in rows)


def test_substring_dedup_keeps_texts_of_one_id_apart(spark):
    """Two texts of one id with equal bits of a checksum: what one repeats is not cut from the other."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = prose(80)
    bits = lambda text: zlib.crc32(text.encode()) & ((1 << 22) - 1)
    known = {bits(f"{passage} {i}"): f"{passage} {i}" for i in range(40_000)}
    body = "é" * 5 + " " + prose(120)
    other = next(t for t in (f"{body} {i}" for i in range(10_000)) if bits(t) in known)
    twin = known[bits(other)]
    df = spark.createDataFrame([(1, passage), (5, twin), (5, other), (5, other)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in substring_dedup.dedupe(df).collect()]
    assert [t for _, t in got].count(other) == 2 and (1, passage) in got and len(got) == 4
    assert all(len(t) < len(twin) for i, t in got if i == 5 and t != other)


def test_rare_languages_of_often_repeated_ids_are_learned(spark):
    rows = [(i, f"the house number {i} is green and old", "en") for i in range(900)]
    rows += [(10_000 + i, f"la casa número {i} es verde y vieja", "es") for i in range(3) for _ in range(1_000)]
    rows += [(None, "das haus ist grün", "de"), (None, "das haus ist grün", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for s in (language.Settings(), language.Settings(per_language=2, landmarks=4)):
        model = language.train(df, s)
        assert model.languages == ["de", "en", "es"]
    asked = spark.createDataFrame([(1, "la casa es vieja", ""), (2, "the old house is green", ""), (3, "das haus ist grün", "")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(asked, language.train(df)).orderBy("doc_id").collect()] == ["es", "en", "de"]


def test_best_fit_passes_bins_of_one_source_in_blocks():
    """More bins than a block holds, most of one source: equal to trying every bin."""
    rng = random.Random(11)
    for sources, clusters in ((1, 5_000), (2, 3), (40, 400)):
        n, capacity = 900, 64
        sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
        own = [(0 if rng.random() < 0.5 else rng.choice([None, *range(sources)]), rng.choice([None, *range(clusters)])) for _ in range(n)]
        bins: list[tuple[int, set, set]] = []
        for size, (source, cluster), (number, offset) in zip(sizes, own, packing.best_fit(sizes, [s for s, _ in own], [c for _, c in own], capacity), strict=True):
            fit = [(left, i) for i, (left, s, c) in enumerate(bins) if left >= size and source not in s - {None} and cluster not in c - {None}]
            left, best = min(fit, default=(capacity, len(bins)))
            assert (number, offset) == (best, capacity - left)
            if best == len(bins):
                bins.append((capacity, set(), set()))
            bins[best] = (left - size, bins[best][1] | {source}, bins[best][2] | {cluster})
