"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from docketry.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def counted(rows, min_chars, min_count):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= min_chars and n >= min_count}


def cuts(word):
    return {word[:i] + word[i + 1:] for i in range(len(word))}


def close(words):
    """All words one edit away, by what is left of a word without one letter."""
    by, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1:]), []).append(w)
    for group in by.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    for w in words:
        for x in cuts(w) & near.keys():
            near[w].add(x)
            near[x].add(w)
    return near


def direct(rows, min_chars=6, min_count=5):
    n = counted(rows, min_chars, min_count)
    near = close(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def result(df, **settings):
    out = spelling.variants(df, **settings)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()))


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = direct(rows)
    assert result(documents) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd, min_count=1, min_chars=3) == direct(rows, 3, 1)


@pytest.mark.parametrize("group", [2, 7, 1000])
@pytest.mark.parametrize("min_chars", [1, 4, 5])
def test_states_that_give_way(spark, group, min_chars):
    """Words over two letters: nearly every stem is hot, so that edits lie before one state and behind the other."""
    draw = random.Random(group * 10 + min_chars)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(min_chars, 9))) for _ in range(220)}
                   | {"abababab" * 3 + c + "bababa" * 3 for c in ("", "a", "b", "ab")})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    got = sorted(map(tuple, spelling.near_words(df, min_chars, group).collect()))
    near = close(words)
    assert got == sorted((w, x) for w in words for x in near[w] if w < x)


def test_chains_ties_and_very_long_words(spark):
    long_word = "".join(chr(97 + (i * i) % 23) for i in range(30_000))
    texts = ([(1, "colour " * 1000)] + [(2, "colours " * 150)] + [(3, "colourss " * 25), (4, "colourzss " * 5)]
             + [(5, "Àbcdef " * 30), (6, "àbcdef " * 30), (7, "xàbcdef " * 5 + "xàbcdeg " * 5)]
             + [(8, f"{long_word} " * 30), (9, f"{long_word}e " * 5), (None, None), (10, "")])
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = direct(texts)
    assert result(df) == want
    by = {r[0]: r for r in want}
    assert by["colourzss"][2] == "colour" and by[long_word + "e"][1] == long_word


def test_minimal_acceptor():
    """Words that end alike share states."""
    start, states = spelling.acceptor(sorted(["walking", "talking", "stalking", "walk", "talk"]))
    assert len(states) == len(set(states)) == 13
    assert [c for c, _ in states[start][1]] == ["s", "t", "w"]
    assert states[start][1][1][1] == states[start][1][2][1]


def test_nothing(nothing):
    assert spelling.variants(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(nothing, times=1)
