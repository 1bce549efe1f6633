"""SimHash, suffix and sentence dedup next to brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm import common, sentence_dedup, simhash, suffix_dedup


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(documents, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    parts = plain_components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == {i: (f"{fps[k]:016x}", ids[parts[k]]) for k, i in enumerate(ids)}


def test_fingerprint_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("only one")).alias("h")).first()
    assert simhash.fingerprint("Only\tONE") == row["h"] % (1 << 64)


@pytest.mark.parametrize("tile", [4096, 3])
def test_links_of_dense_groups(spark, monkeypatch, tile):
    """Groups of near fingerprints, with buckets cut into slices too."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fp = base
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["component"] for r in common.components(simhash.link_edges(df)).collect()}
    parts = plain_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    mine = [got.get(f, f) for f in signed]
    pairs = {(a, b) for a, b in zip(mine, parts)}
    assert len(pairs) == len(set(mine)) == len(set(parts))


def test_components_of_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}


def test_simhash_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == 1 and by[5]["component_id"] == 4 and by[7]["component_id"] == 6
    assert sum(r["doc_id"] == 9 for r in rows) == 2
    assert simhash.near_duplicates(nothing).collect() == []


# --- suffix dedup


def plain_removal(docs):
    """Per document: bytes covered by a 100-byte string that also starts earlier."""
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            s = raw[p:p + 100]
            if s in seen:
                gone[p:p + 100] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def by_id(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_dedup_equals_brute_force(documents, texts):
    assert by_id(suffix_dedup.remove_repeats(documents)) == plain_removal(sorted(texts.items()))


@pytest.mark.parametrize("run", [1 << 16, 40])
def test_suffix_dedup_of_planted_repeats(spark, monkeypatch, run):
    """Repeats of every length around 100, periodic and constant texts, and edits; runs of many tasks are merged."""
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_AT_ONCE", run)
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(n)) for n in (99, 100, 101, 150, 400)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 6)):
            part = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(part))
                part = part[:at] + rng.choice("xyz") + part[at + 1:]
            parts += [part, "".join(rng.choice("efgh") for _ in range(rng.randint(0, 60)))]
        docs.append((i, "".join(parts)))
    docs += [(50, "a" * 350), (51, "ab" * 200), (52, "a" * 120), (53, "abc" * 30), (54, pool[4] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert by_id(suffix_dedup.remove_repeats(df)) == plain_removal(docs)


def test_suffix_dedup_odd_rows(odd, nothing):
    rows = suffix_dedup.remove_repeats(odd, keep=("part",)).collect()
    assert len(rows) == odd.count() and {r["part"] for r in rows} == {"y"}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == 0 and by[7]["n_removed"] == by[7]["n_bytes"] and by[7]["kept_text"] == ""
    assert by[9]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(nothing).collect() == []


# --- sentence dedup


def plain_sentences(docs):
    seen, out = {}, {}
    for i, text in docs:
        pieces = sentence_dedup.sentences(text)
        assert "".join(pieces) == text
        norm = [" ".join(p.lower().split()) for p in pieces]
        gone = [False] * len(pieces)
        for a in range(len(pieces)):
            for b in range(a + 2, len(pieces) + 1):
                if sum(len(n.split()) for n in norm[a:b]) >= 12:
                    if seen.setdefault(tuple(norm[a:b]), (i, a)) != (i, a):
                        gone[a:b] = [True] * (b - a)
                    break
        out[i] = (len(pieces), sum(gone), "".join(p for p, g in zip(pieces, gone) if not g))
    return out


def test_sentence_dedup_equals_brute_force(documents, texts):
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["kept_text"])
           for r in sentence_dedup.remove_repeated_sentences(documents.repartition(5)).collect()}
    assert got == plain_sentences(sorted(texts.items()))


def test_sentence_dedup_keeps_the_first(spark):
    passage = "Here is a passage of some length. It has a second sentence in it. And it ends with a third one."
    docs = [(1, "Own start. " + passage + " Own end."), (2, "Other words before. " + passage), (3, "Clean text. Nothing here.")]
    rows = {r["doc_id"]: r for r in sentence_dedup.remove_repeated_sentences(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1]["n_removed"] == 0 and rows[3]["n_removed"] == 0
    assert rows[2]["kept_text"] == "Other words before." and rows[2]["n_spans"] == 1


def test_sentence_dedup_odd_rows(odd, nothing):
    rows = sentence_dedup.remove_repeated_sentences(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["kept_text"] == "" and by[1]["n_sentences"] == 0 and by[9]["n_removed"] == 0
    assert by[7]["n_removed"] == by[7]["n_sentences"]
    assert sentence_dedup.remove_repeated_sentences(nothing).collect() == []


def test_rows_without_an_id_or_with_a_shared_one_are_cut_apart(spark):
    """Where one text of an id repeats an earlier one, the others keep what stands at the same place."""
    line = "This very line of the licence stands in several of the texts and is cut out of all but the first one here. "
    line += "It has a second sentence of more than a dozen words, so that it is a run of its own in both ways. "
    alone = [" ".join(f"{k}only{n}x{j}" for j in range(14)) + ". " for k in "abcdef" for n in range(4)]
    texts = ["".join(alone[4 * k:4 * k + 4]) for k in range(6)]
    rows = [(None, line + texts[0]), (None, line + texts[1]), (None, texts[2]), (7, texts[3]), (7, line + texts[4]),
            (7, texts[5]), (7, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for out in (suffix_dedup.remove_repeats(df), sentence_dedup.remove_repeated_sentences(df)):
        kept = [r["kept_text"] for r in out.collect()]
        assert sum(line in k for k in kept) == 1 and len(kept) == len(rows)
        for text, n in zip(texts, (1, 1, 1, 1, 1, 2)):
            assert sum(text.strip()[1:] in k for k in kept) == n
