"""Sharding, mixing and packing: invariants and brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import mixing, packing, sharding


def test_table_is_filled_in_turns():
    names, slots = ["a", "b", "c"], 13
    owner = sharding.fill(names, slots)
    order = []
    for n in names:
        at, skip = sharding._number(f"{n}|offset") % slots, sharding._number(f"{n}|skip") % (slots - 1) + 1
        order.append([(at + j * skip) % slots for j in range(slots)])
    want = [None] * slots
    turn = 0
    while None in want:
        free = next(s for s in order[turn % 3] if want[s] is None)
        want[free] = turn % 3
        turn += 1
    assert owner == want
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1


def test_losing_a_shard_moves_few_slots():
    names = sharding.shard_names()
    full, less = sharding.fill(names), sharding.fill(names[:-1])
    moved = sum(a != b for a, b in zip(full, less) if a != len(names) - 1)
    assert moved < 0.1 * sharding.SLOTS


@pytest.mark.parametrize("names,slots", [([], 7), (["a", "a"], 7), (["a", "b", "c"], 2), (["a"], 9)])
def test_bad_tables_raise(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_place_odd_rows(odd, nothing, tmp_path):
    rows = sharding.place(odd, "doc_id", sharding.shard_names(4), 101)
    got = rows.collect()
    assert len(got) == odd.count() and set(rows.columns) == {*odd.columns, "slot", "shard"}
    assert len({r["shard"] for r in got if r["doc_id"] == 9}) == 1
    assert sharding.place(nothing, "doc_id", sharding.shard_names(4), 101).collect() == []
    sharding.write_shards(rows.select("doc_id", "slot", "shard"), str(tmp_path / "out"), 2)
    assert odd.sparkSession.read.parquet(str(tmp_path / "out")).count() == odd.count()


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Reshare the excess until no source is above its ceiling."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, open_, left = {}, set(keys), share * sum(sizes.values())
    while open_:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > ceiling * sizes[k]]
        if not over:
            target.update({k: left * weight[k] / total for k in open_})
            break
        for k in over:
            target[k] = ceiling * sizes[k]
        left -= sum(target[k] for k in over)
        open_ -= set(over)
    return target


def check_mix(rows, texts):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    biggest = defaultdict(int)
    for r, source in rows:
        size[source] += r["size"]
        taken[source] += r["taken"]
        target[source] = r["target"]
        biggest[source] = max(biggest[source], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["taken"] in (0, r["size"], 2 * r["size"])
    want = plain_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= biggest[s] + 1e-6


@pytest.mark.parametrize("block", [4096, 8])
def test_mix_meets_targets(documents, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    rows = mixing.mix(documents).collect()
    assert len(rows) == len(source)
    check_mix([(r, source[r["doc_id"]]) for r in rows], None)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 30).tolist()
    psi = rng.uniform(0, 1, 30).tolist()
    mean = np.zeros(30)
    for k in range(3000):
        out = mixing.flight(sizes, psi, np.random.default_rng(k).uniform(0, 1, 30).tolist())
        assert sum(0 < p < 1 for p in out) <= 2
        assert np.dot(out, sizes) == pytest.approx(np.dot(psi, sizes), rel=1e-6)
        assert sum(out) == pytest.approx(sum(psi), rel=1e-6)
        mean += out
    assert np.abs(mean / 3000 - psi).max() < 0.05


def test_landing_takes_the_nearest():
    assert mixing.land([10, 100], [0.6, 0.1]) == [1.0, 0.0]
    assert mixing.land([5], [1.0]) == [1.0]


def test_mix_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(nothing).collect() == []


# --- packing


def test_best_fit_takes_the_tightest_compatible_bin():
    # bins after the first three: room 4 (lane a), 3 (lane b), 2 (lane c)
    sizes, lanes = [6, 7, 8, 2, 2, 3], ["a", "b", "c", "c", "d", "b"]
    assert packing.best_fit(sizes, lanes, [None] * 6, 10) == [0, 1, 2, 1, 2, 0]
    assert packing.best_fit([1, 1, 1], ["a", "b", "c"], [5, 5, 6], 10) == [0, 1, 0]


def plain_best_fit(sizes, lanes, clusters, capacity):
    bins, out = [], []
    for s, lane, c in zip(sizes, lanes, clusters):
        fit = [(b["room"], i) for i, b in enumerate(bins)
               if b["room"] >= s and b["room"] > 0 and (lane is None or lane not in b["lanes"])
               and (c is None or c not in b["clusters"])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "lanes": set(), "clusters": set()})
        bins[i]["room"] -= s
        bins[i]["lanes"].add(lane)
        bins[i]["clusters"].add(c)
        out.append(i)
    return out


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(20):
        sizes = rng.integers(1, 60, 200).tolist()
        lanes = [None if x == 0 else int(x) for x in rng.integers(0, 9, 200)]
        clusters = [None if x == 0 else int(x) for x in rng.integers(0, 40, 200)]
        assert packing.best_fit(sizes, lanes, clusters, 100) == plain_best_fit(sizes, lanes, clusters, 100)


def test_pack_keeps_every_word_and_no_conflict(documents, texts):
    rows = packing.pack(documents).collect()
    words = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        assert r["start_word"] == r["piece"] * packing.CAPACITY
        words[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    assert words == {i: len(t.encode().split()) for i, t in texts.items()}
    for b, own in bins.items():
        if b is not None:
            assert sum(r["n_words"] for r in own) <= packing.CAPACITY
            assert len({texts[r["doc_id"]] for r in own}) == len(own)


def test_pack_odd_rows(odd, nothing):
    rows = packing.pack(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["bin_id"] is None and by[1][0]["n_words"] == 0
    assert len(by[9]) == 2 and by[9][0]["bin_id"] != by[9][1]["bin_id"]
    assert sum(r["n_words"] for r in by[6]) == 5 * 20_000
    assert packing.pack(nothing).collect() == []


BIG = [2**53 + 1, 2**53 + 3, 2**62 + 1]


def test_large_ids_beside_a_null(spark):
    """Ids beyond what a double holds come back as they went in."""
    rows = [(i, f"words of text {i} " * 5, "s") for i in [*BIG, None, 5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    want = sorted([*BIG, None, 5], key=str)
    assert sorted((r["doc_id"] for r in packing.pack(df).collect()), key=str) == want
    assert sorted((r["doc_id"] for r in mixing.mix(df).collect()), key=str) == want
