"""Spot signatures and vector links next to brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import spotsigs, vector_dedup

COMMON = {w for line in spotsigs.ANCHORS.values() for w in line.split()}


def plain_pieces(text):
    out, current = [], None
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        if w in COMMON:
            current = ["~" + w]
            out.append(current)
        else:
            content = 0 if current is None else len(current) - current[0].startswith("~")
            if current is None or content == spotsigs.STRETCH:
                current = []
                out.append(current)
            current.append(w)
    return out


def plain_signatures(text):
    """Chains as word tuples."""
    out, parts = set(), plain_pieces(text)
    for p, after in zip(parts, [*parts[1:], []]):
        words = p + [w for w in after if not w.startswith("~")]
        out.add(tuple(words[:3 if words[0].startswith("~") else 2]))
    return out


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints_equal_brute_force(documents, texts):
    rows = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(documents.repartition(3)).collect()}
    ids = sorted(texts)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        t, n = texts[i], len(texts[i])
        edited = t[:n - n // 4] + texts[after][:n // 4]
        own, changed, following = map(plain_signatures, (t, edited, texts[after]))
        assert rows[i]["n_chars"] == n
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["near_edited"] == pytest.approx(plain_jaccard(own, changed))
        assert rows[i]["near_next"] == pytest.approx(plain_jaccard(own, following))
        assert rows[i]["n_signatures"] == len(own)
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_near_pairs_equal_brute_force(documents, texts):
    members, pairs = spotsigs.near_pairs(documents, 0.5)
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    sigs = {i: plain_signatures(t) for i, t in texts.items()}
    classes = {}
    for i in sorted(sigs):
        classes.setdefault(frozenset(sigs[i]), i)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {i: classes[frozenset(s)] for i, s in sigs.items()}
    heads = sorted(classes.values())
    want = {(a, b): plain_jaccard(sigs[a], sigs[b]) for k, a in enumerate(heads) for b in heads[k + 1:]}
    assert got == pytest.approx({p: x for p, x in want.items() if x >= 0.5 and sigs[p[0]]})
    assert got


def test_no_python_in_the_plan(documents):
    plan = spotsigs.edited_fingerprints(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_spotsigs_odd_rows(spark, odd, nothing):
    rows = spotsigs.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_chars"] == 0 and by[1]["fingerprint"] == "" and by[1]["near_edited"] == 1.0
    assert by[4]["fingerprint"] == by[5]["fingerprint"] and by[6]["near_next"] == 1.0
    assert spotsigs.edited_fingerprints(nothing).collect() == []
    alone = spotsigs.edited_fingerprints(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0


# --- vectors


def brute_links(rows, cosine=0.98):
    """vec_id -> (n_links, component_id)."""
    ok = [(i, np.array(v, float), y) for i, v, y in rows
          if v and y is not None and all(c is not None and np.isfinite(c) for c in v) and np.any(v)]
    n, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, y) in enumerate(ok):
        for j, b, z in ok[:k]:
            if y == z and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                x, w = find(i), find(j)
                root[max(x, w)] = min(x, w)
    return {i: (n[i], find(i)) for i in n}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("most", [1024, 60])
def test_links_of_clusters(spark, monkeypatch, most):
    """Clusters, a dense ball larger than a shard, copies, and rows that link with nothing; small shards split often."""
    monkeypatch.setattr(vector_dedup, "SHARD_MOST", most)
    monkeypatch.setattr(vector_dedup, "SHARD", most // 2)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(40):
        base = rng.normal(size=24)
        for _ in range(150 if c == 0 else int(rng.integers(1, 8))):
            v = base + rng.normal(size=24) * 0.06
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 3))
    rows += [(len(rows) + k, rows[5][1], 0) for k in range(30)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, rows[5][1], None),
             (n + 4, [float("nan")] + rows[5][1][1:], 0), (n + 5, [None] + rows[5][1][1:], 0),
             (n + 6, rows[5][1][:10], 0), (n + 7, [float("inf")] * 24, 2)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors(spark, rows)).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    true, found = sum(w[0] for w in want.values()), sum(g["n_links"] for g in got.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert found >= 0.97 * true and next(iter(got.values()))["audit_recall"] >= 0.9
    same = sum(got[i]["component_id"] == want[i][1] for i in want)
    assert same >= 0.97 * len(want)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in want)
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in range(8))


def test_vectors_of_the_table(spark, documents):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df).collect()}
    assert got == brute_links(rows)


def test_pruned_graph_reaches_all():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[:120] = x[0] + rng.normal(size=(120, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists, medoid = vector_dedup.build_graph(x)
    seen, edge = {medoid}, [medoid]
    while edge:
        edge = [q for p in edge for q in lists[p] if q not in seen and not seen.add(q)]
    assert len(seen) == 300
    found = vector_dedup.range_search(x, [np.array(a) for a in lists], [medoid], x[5], 0.98, 16)
    assert sorted(found) == np.flatnonzero(x @ x[5] >= 0.98).tolist()


def test_vectors_empty(spark):
    assert vector_dedup.near_vectors(vectors(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    twice = vector_dedup.near_vectors(vectors(spark, [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [2.0, 4.0], 1)]))
    rows = twice.orderBy(F.col("vec_id").asc_nulls_first()).collect()
    assert [r["n_links"] for r in rows] == [2, 2, 2] and rows[0]["kept"]


def test_vectors_with_null_and_shared_ids(spark):
    """Rows without an id are vectors of their own, as are those of an id given under two labels."""
    rows = [(10, [1.0, 0.0, 0.0], "a"), (None, [1.0, 0.05, 0.0], "a"), (None, [0.0, 1.0, 0.0], "a"), (20, [0.0, 1.0, 0.05], "a"),
            (30, [0.0, 1.0, 0.1], "a"), (5, [0.0, 0.0, 1.0], "b"), (5, [0.0, 0.0, 1.0], "c"), (40, [0.0, 0.05, 1.0], "b"),
            (50, [0.0, 0.05, 1.0], "c"), (60, [0.0, 0.1, 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df).collect()), key=str)
    want = [(10, 1, None), (None, 1, None), (None, 2, None), (20, 2, None), (30, 2, None), (5, 1, 5), (5, 2, 5), (40, 1, 5),
            (50, 2, 5), (60, 2, 5)]
    assert got == sorted(want, key=str)
