"""Each stage of the pipeline on its own input, next to brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from docketry.llm.common import landed
from docketry.llm.toxicity import toxicity

from .conftest import DATA
from .test_near_duplicates import plain_components, plain_fingerprint, plain_removal
from .test_placing import plain_targets


@pytest.fixture(scope="module")
def stages(spark, documents):
    """Input and output rows of every stage."""
    docs, out = documents, []
    for name, stage in cp.STAGES:
        after = landed(stage(spark, docs, DATA), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n.split()[0] for n, _, _ in stages] == ["toxicity", "simhash", "suffix-array", "source", "best-fit"]
    assert all(after.columns == cp.COLUMNS for _, _, after in stages[:-1])


def test_toxic_documents_leave(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = {r["doc_id"] for r in toxicity(before, labels).collect() if r["predicted"]}
    want = sorted(tuple(r) for r in before.select(cp.COLUMNS).collect() if r["doc_id"] not in out)
    assert sorted(tuple(r) for r in after.collect()) == want


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    parts = plain_components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({ids[p] for p in parts})


def test_repeats_are_cut(stages):
    _, before, after = stages[2]
    want = plain_removal(sorted((r["doc_id"], r["text"]) for r in before.collect()))
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        n, removed, spans, digest = want[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
        assert n - removed - 4 * 2 * spans <= len(r["text"].encode()) <= n - removed
        if not removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest


def test_mix_is_near_its_targets(stages):
    _, before, after = stages[3]
    times = Counter(r["doc_id"] for r in after.collect())
    size, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.collect():
        n = len((r["text"] or "").encode().split())
        size[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
        biggest[r["source"]] = max(biggest[r["source"]], n)
    assert max(times.values()) <= 2
    for s, target in plain_targets(size).items():
        assert abs(taken[s] - target) <= biggest[s] + 1e-6


def test_bins_hold_all_words(stages):
    _, before, after = stages[4]
    words, room = Counter(), Counter()
    for r in after.collect():
        words[r["doc_id"]] += r["n_words"]
        room[r["bin_id"]] += r["n_words"]
    want = Counter()
    for r in before.collect():
        want[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert words == want and max(room.values()) <= 2048


def test_run_goes_through_all_stages(spark, stages):
    rows = sorted(tuple(r) for r in cp.run(spark, DATA).collect())
    assert rows == sorted(tuple(r) for r in stages[-1][2].collect())


def test_stages_take_empty_tables(spark, documents):
    docs = documents.limit(0)
    for _, stage in cp.STAGES:
        docs = landed(stage(spark, docs, DATA), "stage")
        assert docs.count() == 0
