"""Phrase collocations against direct counts, and the summaries' guarantee."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import collocation

LOWER = {c: c + 32 for c in range(65, 91)}


def direct(rows, most=3, threshold=10, cover=50, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in range(1, most + 1):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        held = [p for p in f if len(p) > 1 and f[p] >= threshold]
        longest = Counter()
        for p in held:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i:i + m]] = max(longest[p[i:i + m]], f[p])
        rows = []
        for p in held:
            a = f[p]
            if longest[p] and 100 * longest[p] >= cover * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def result(df, **settings):
    out = collocation.collocations(df, **settings)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


def test_documents(documents):
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    want = direct(rows)
    assert result(documents) == want and len({r[0] for r in want}) == 4


def test_small_chunks_and_blocks(documents, monkeypatch):
    """Texts cut at piece ends, many blocks and hash partitions: same rows. The settings are read where tasks are made."""
    rows = [(r["text"], r["lang"]) for r in documents.limit(60).collect()]
    data = [(t.encode().translate(collocation.LOWER), lang) for t, lang in rows]
    monkeypatch.setattr(collocation, "CHUNK", 300)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [x for _, x in rows], "text": [x for x, _ in rows]})
    cut = list(collocation.chunks(iter([batch])))
    assert len(cut) > 60
    words = Counter()
    for chunk in cut:
        (_, starts, ends, _), doc, _ = collocation.phrase_keys(*chunk, 3)
        words.update((chunk[2][d], bytes(chunk[0][s:e])) for s, e, d in zip(starts, ends, doc))
    want = Counter((lang, w) for x, lang in data for w in re.findall(b"[^ \t.,;:!?\n\x0b\x0c\r]+", x))
    assert words == want


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, ties, phrases that overlap themselves, and clashing columns."""
    long_text = "so it goes and so it goes " * 40_000
    rows = ([(None, "en"), ("", "en"), (" \t\n", None), ("A b a B a b", None), ("a a a a a a a a a a a a", "xx")]
            + [("New York city hall. new York city", "en"), ("Ünï CÖDÉ çödé; Ünï CÖDÉ", "de")] * 12
            + [("repeated row of words", None)] * 11 + [(long_text, "long"), ("und written out", "und")])
    df = spark.createDataFrame([(t, x, "f", 1, "p", 2.0) for t, x in rows],
                               "text string, lang string, phrase string, f int, part string, score double")
    assert result(df) == direct(rows)
    assert result(df, threshold=3, cover=90, top=2, most=4) == direct(rows, 4, 3, 90, 2)


def test_exact_beyond_64_bits(spark):
    """Counts of trillions: the score's products pass 64 bits."""
    f = [("en", "x", 9_007_199_254_741), ("en", "y", 8_007_199_254_740), ("en", "x y", 7_999_999_999_999)]
    counts = spark.createDataFrame(f, "lang string, phrase string, f long")
    cand = spark.createDataFrame([("en", "x y", 7_999_999_999_999, ["x", "y"])],
                                 "lang string, phrase string, a long, words array<string>")
    got = collocation.weakest_cuts(cand, counts).first()
    assert got["score"] == 1_000_000 * f[2][2] ** 2 // (f[0][2] * f[1][2])


@pytest.mark.parametrize("seed", range(6))
def test_summaries_lose_nothing_frequent(seed):
    """Merged in any order with the least capacity allowed, every key with the threshold's count survives."""
    draw, threshold = random.Random(seed), 10
    keys = np.array([int(draw.paretovariate(0.6)) % 5000 for _ in range(20_000)], np.uint64)
    summary = collocation.Summary(len(keys) // threshold + 1)
    for block in np.array_split(keys, 13):
        assert all(np.array_equal(x, y) for x, y in zip(collocation.unpacked(collocation.packed(*collocation.summed(block))),
                                                        collocation.summed(block)))
        summary.merge(*[[x] for x in collocation.summed(block)])
    true = Counter(keys.tolist())
    left = set(summary.possible(threshold).tolist())
    assert {k for k, n in true.items() if n >= threshold} <= left and summary.loss < threshold
    tight = collocation.Summary(50)
    for block in np.array_split(keys, 13):
        tight.merge(*[[x] for x in collocation.summed(block)])
    assert tight.loss and len(tight.keys) <= 50
    assert all(0 <= true[k] - n <= tight.loss for k, n in zip(tight.keys.tolist(), tight.counts.tolist()))


def test_nothing(nothing):
    assert collocation.collocations(nothing.withColumnRenamed("source", "lang")).count() == 0
