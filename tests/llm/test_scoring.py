"""Toxicity and LM scoring: exact search next to brute force, held-out accuracy, gradients, likelihoods."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import lm_scoring, toxicity

BAD = ["vilethe", "grobnast", "skurfle"]


@pytest.fixture(scope="module")
def labelled(spark):
    """600 texts; the toxic ones hold one of three words, or a word that starts like the fourth."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{rng.integers(0, 300)}" for _ in range(40)]
        y = int(i % 5 == 0)
        if y:
            words[int(rng.integers(0, 40))] = BAD[i % 3] if i % 2 else f"zorkel{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(words)))
        if i % 7:
            labels.append((i, y, 1))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    idf = rng.uniform(1, 4, 40)
    rows = []
    for i in range(700):
        t = sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist())
        rows.append((i, t, rng.integers(1, 4, len(t)).tolist(), int(rng.integers(0, 2))))
    index = toxicity.BlockMaxIndex.build(rows, idf)
    dense = np.zeros((700, 40))
    for i, t, f, _ in rows:
        dense[i, t] = toxicity.weights(t, f, idf)
    for i, t, f, y in rows[:150]:
        q = toxicity.weights(t, f, idf)
        cos = np.round(dense[:, t] @ q, 10)
        want = sorted(cos[cos > 0].tolist(), reverse=True)
        at, got = index.top(t, q, 10)
        each = np.repeat(np.round(got, 10), index.counts[at])
        assert len(each) >= min(10, len(want)) and np.allclose(each[:10], want[:10])
        assert index.counts[at][:-1].sum() < 10  # no more vectors than needed
        # held one out: the vote without the example itself
        rest = [(toxicity.weights(*r[1:3], idf), r[3], cos[r[0]]) for r in rows if r[0] != i and cos[r[0]] > 0]
        if len(rest) <= toxicity.NEIGHBOURS:
            w = np.array([1 / (1.05 - min(c, 1.0)) for _, _, c in rest])
            plain = (w @ np.array([z for _, z, _ in rest]) + 0.3) / (w.sum() + 1) if rest else 0.3
            assert toxicity._votes(index, 0.3, t, f, y)[0] == pytest.approx(plain, abs=1e-6)


def test_toxic_words_are_found(spark, labelled):
    docs, labels = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 600 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert 150 < len(held) < 250
    right = [r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]
    assert np.mean(right) > 0.97
    assert all(r["evidence"] for r in held if r["predicted"])


def test_held_out_labels_are_not_learned_from(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    plain = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()} == plain


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    raw = rng.uniform(0, 1, 400)
    y = (rng.uniform(0, 1, 400) < raw**2).astype(float)
    edges, values = toxicity.isotonic(raw, y, 0.3)
    assert (np.diff(edges) >= 0).all() and (np.diff(values) >= 0).all()
    assert abs(np.interp(raw, edges, values).mean() - y.mean()) < 0.03


def test_toxicity_odd_rows(spark, odd, nothing, labelled):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None), (8, 3)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(nothing, labels).collect() == []
    assert len(toxicity.toxicity(odd, labelled[1].limit(0)).collect()) == odd.count()


# --- LM scoring


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(3)
    classes = rng.integers(1, 5, 4000).astype(np.uint8)
    classes[2::3] = classes[1::3][: len(classes[2::3])]  # a word repeats the one to its left
    at = np.arange(len(classes))
    ctx = lm_scoring.contexts(classes, at)
    net = lm_scoring.Network.start(np.bincount(classes, minlength=lm_scoring.CLASSES))
    trainer = lm_scoring._Trainer(net)
    before = net.log_probabilities(ctx, classes).mean()
    for _ in range(60):
        trainer.step(ctx, classes)
    assert net.log_probabilities(ctx, classes).mean() > before + 0.15


def test_gradient_is_the_numerical_one():
    rng = np.random.default_rng(4)
    ctx = rng.integers(0, 20, (16, 4)).astype(np.uint8)
    tgt = rng.integers(0, 20, 16).astype(np.uint8)
    net = lm_scoring.Network.start(np.ones(lm_scoring.CLASSES))
    trainer = lm_scoring._Trainer(lm_scoring.Network.of(net.flat()))
    trainer.squares = [np.full_like(x, 1e-20) for x in trainer.squares]
    trainer.step(ctx, tgt)  # from zero squares a step is the gradient's sign times the rate
    for k, c in ((0, int(ctx[0, 0])), (3, int(ctx[1, 3]))):
        for h in range(4):
            moved = lm_scoring.Network.of(net.flat())
            loss = []
            for e in (1e-2, -1e-2):
                moved.rows[k, c, h] = net.rows[k, c, h] + e
                loss.append(-moved.log_probabilities(ctx, tgt).mean())
            slope = loss[0] - loss[1]
            if abs(slope) > 1e-4:
                assert np.sign(net.rows[k, c, h] - trainer.net.rows[k, c, h]) == np.sign(slope)


def test_places_in_order_are_narrow_and_stable():
    """Keys of a training step fit 32 bits; equal numbers stay in the order of their places."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2 * lm_scoring.WORDS, 4 * lm_scoring.BATCH).astype(np.int32)
    x[::3] = 2 * lm_scoring.WORDS - 1
    places, ids = lm_scoring._in_order(x)
    assert ids.dtype == np.int32 and (places == np.argsort(x, kind="stable")).all() and (ids == np.sort(x)).all()
    assert (lm_scoring._starts(ids) == np.unique(ids, return_index=True)[1]).all()
    long = rng.integers(0, 2 * lm_scoring.WORDS, 20_000)
    assert (lm_scoring._in_order(long)[0] == np.argsort(long, kind="stable")).all()


def test_scores_are_sums_over_positions(documents, texts):
    rows = {r["doc_id"]: r for r in lm_scoring.score(documents).collect()}
    assert set(rows) == set(texts)
    assert all(r["n_tokens"] == len(texts[i].encode().split()) for i, r in rows.items())
    classes = np.arange(lm_scoring.BUCKETS) % (lm_scoring.CLASSES - 1) + 1
    classes = classes.astype(np.uint8)
    inner = lm_scoring.within_class(np.ones(lm_scoring.BUCKETS), classes)
    net = lm_scoring.Network.start(np.ones(lm_scoring.CLASSES))
    codes = lm_scoring.encode("some words of one text some words again and more of the words")
    total = 0.0
    c = classes[codes].astype(int)
    for i in range(len(codes)):
        side = [c[j] if 0 <= j < len(c) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(sum(net.rows[k][side[k]] for k in range(4)) + net.b)
        z = (h @ net.out + net.bias).astype(float)
        total += z[c[i]] - np.log(np.exp(z).sum()) + inner[codes[i]]
    assert abs(lm_scoring.pseudo_likelihood(codes, net, classes, inner) - total) < 1e-3


def test_probabilities_sum_to_one():
    counts = np.random.default_rng(0).integers(0, 50, lm_scoring.BUCKETS)
    classes = lm_scoring.classes_of(counts)
    inner = np.exp(lm_scoring.within_class(counts, classes))
    assert np.allclose(np.bincount(classes, weights=inner)[1:], 1.0)
    net = lm_scoring.Network.start(np.bincount(classes, minlength=lm_scoring.CLASSES))
    ctx = np.tile(np.array([[3, 7, 0, 9]], np.uint8), (lm_scoring.CLASSES, 1))
    assert abs(np.exp(net.log_probabilities(ctx, np.arange(lm_scoring.CLASSES))).sum() - 1) < 1e-4


def test_shuffled_text_scores_lower(spark):
    rng = np.random.default_rng(6)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("one", "two"), ("red", "blue")]
    text = lambda: " ".join(w for _ in range(60) for w in pairs[rng.integers(0, 4)])
    docs = [(i, text()) for i in range(300)]
    mixed = docs[0][1].split()
    rng.shuffle(mixed)
    docs.append((900, " ".join(mixed)))
    rows = {r["doc_id"]: r["per_token"] for r in lm_scoring.score(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[900] < min(rows[i] for i in range(300))


def test_every_position_is_a_target_once(monkeypatch):
    met = []
    step = lm_scoring._Trainer.step
    monkeypatch.setattr(lm_scoring._Trainer, "step", lambda self, *a: (met.extend(a[1].tolist()), step(self, *a))[1])
    classes = (np.arange(lm_scoring.BUCKETS) % lm_scoring.CLASSES).astype(np.uint8)
    cuts = np.cumsum([1, 2, 5, 15, 16, 40])  # the class of a position tells which one it is
    codes = [c.astype(np.uint16).tobytes() for c in np.split(np.arange(lm_scoring.CLASSES), cuts)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([4, None, 7, 1, -3, 2, 11]), "codes": pa.array(codes, pa.binary())})
    net = lm_scoring.Network.start(np.ones(lm_scoring.CLASSES))
    for r in range(lm_scoring.ROUNDS):
        list(lm_scoring._local_training(net.sent(), classes, r, lm_scoring.ROUNDS)(iter([batch])))
    assert sorted(met) == list(range(lm_scoring.CLASSES))


def test_texts_laid_out_together_see_their_own_neighbours():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, lm_scoring.BUCKETS, n).astype(np.uint16) for n in (0, 1, 5, 0, 3)]
    classes = rng.integers(1, lm_scoring.CLASSES, lm_scoring.BUCKETS).astype(np.uint8)
    codes, c, at, within = lm_scoring.laid_out(texts, classes)
    alone = [np.arange(len(t)) for t in texts]
    assert (within == np.concatenate(alone)).all() and (codes[at] == np.concatenate(texts)).all()
    assert (lm_scoring.contexts(c, at) == np.concatenate([lm_scoring.contexts(classes[t], a) for t, a in zip(texts, alone)])).all()
    assert (lm_scoring.neighbours(codes, at) == np.concatenate([lm_scoring.neighbours(t, a) for t, a in zip(texts, alone)])).all()


class Counted(np.ndarray):
    """An array that notes how many of its rows are read."""

    read = 0

    def take(self, at, **options):
        Counted.read += np.size(at)
        return np.asarray(self).take(at, **options)


def word_network(rng):
    net = lm_scoring.Network.start(np.ones(lm_scoring.CLASSES))
    net.words[:] = rng.normal(0, 0.1, net.words.shape)
    return net


def test_a_step_reads_a_word_row_once(monkeypatch):
    """The rows and their squares are read once for each word of a batch, and move by the sum over its positions."""
    rng = np.random.default_rng(10)
    near = 2 * rng.integers(0, 90, (300, 4)) + np.array([0, 0, 1, 1])
    near[:, 2] = 2 * rng.integers(1000, 60_000, 300) + 1  # most of these occur once
    ctx, tgt = rng.integers(0, lm_scoring.CLASSES, (300, 4)), rng.integers(0, lm_scoring.CLASSES, 300)
    net = word_network(rng)
    before = lm_scoring.Network.of(net.flat())
    net.words = net.words.view(Counted)
    trainer = lm_scoring._Trainer(net)
    monkeypatch.setattr(Counted, "read", 0)
    trainer.step(ctx, tgt, near)
    assert Counted.read == 2 * len(np.unique(near))
    h = before.hidden(ctx, near)
    p = np.exp(before.odds(h))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(300), tgt] -= 1
    back = (p / 300 @ before.out.T) * (1 - h * h)
    grad = np.zeros(net.words.shape)
    np.add.at(grad, near, back[:, None])
    want = before.words - lm_scoring.RATE * grad / np.sqrt(lm_scoring.WORD_SQUARES + grad * grad)
    assert np.allclose(net.words, want, atol=1e-4) and (net.words != before.words).any()


def test_a_text_looks_its_words_up_once(monkeypatch):
    """One row a side for each word of a text and the edges; the same values to the last bit as position by position."""
    rng = np.random.default_rng(11)
    texts = [rng.integers(0, lm_scoring.BUCKETS, n).astype(np.uint16) for n in (0, 1, 2, 7, 300)]
    classes = rng.integers(1, lm_scoring.CLASSES, lm_scoring.BUCKETS).astype(np.uint8)
    inner = rng.normal(-5, 1, lm_scoring.BUCKETS)
    net = word_network(rng)
    want = []
    for t in texts:
        at = np.arange(len(t))
        c = classes[t]
        want.append(net.log_probabilities(lm_scoring.contexts(c, at), c, lm_scoring.neighbours(t, at)).sum() + inner[t].sum()
                    if len(t) else 0.0)
    net.words = net.words.view(Counted)
    monkeypatch.setattr(Counted, "read", 0)
    assert lm_scoring.pseudo_likelihoods(texts, net, classes, inner).tolist() == want
    assert Counted.read == 2 * sum(len(t) + 2 * lm_scoring.SIDE for t in texts if len(t))


def test_words_of_many_texts_are_counted_together(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [rng.integers(0, lm_scoring.BUCKETS, 20).astype(np.uint16) for _ in range(200)] + [np.empty(0, np.uint16)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(201), pa.int64()), "codes": pa.array([t.tobytes() for t in texts])})
    calls, bincount = [], np.bincount
    monkeypatch.setattr(lm_scoring.np, "bincount", lambda *a, **k: (calls.append(1), bincount(*a, **k))[1])
    rows = [r for b in lm_scoring._count(iter([batch])) for r in b.to_pylist()]
    assert len(calls) == 1
    ids, n = np.unique(np.concatenate(texts), return_counts=True)
    assert [(r["bucket"], r["n"]) for r in rows] == list(zip(ids.tolist(), n.tolist()))


def test_overflow_is_seen_before_it_happens():
    """A trainer looks at its weights again before steps could have taken a logit beyond the safe bound."""
    rng = np.random.default_rng(13)
    net = word_network(rng)
    trainer = lm_scoring._Trainer(net)
    ctx, tgt = rng.integers(0, 9, (64, 4)), rng.integers(0, 9, 64)
    for _ in range(40):
        trainer.step(ctx, tgt)
        assert trainer.most + lm_scoring.RATE * (lm_scoring.HIDDEN + 1) >= net.most()
    net.out *= 1000
    trainer.most = net.most()
    trainer.step(ctx, tgt)
    assert np.isfinite(net.flat()).all()


def test_rare_words_tell_their_neighbours(spark):
    """Each of 600 words has one partner; texts of wrong partners have the same words, and mostly the same classes."""
    rng = np.random.default_rng(9)
    text = lambda off: " ".join(f"left{k} right{(k + off) % 600}" for k in rng.integers(0, 600, 7))
    docs = [(i, text(0)) for i in range(6000)] + [(10_000 + i, text(300 + i)) for i in range(50)]
    rows = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    right = np.mean([r["per_token"] for r in rows if r["doc_id"] < 10_000])
    assert right > np.mean([r["per_token"] for r in rows if r["doc_id"] >= 10_000]) + 0.5


def test_lm_odd_rows(odd, nothing):
    rows = lm_scoring.score(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == 0 and by[2]["log_likelihood"] == 0.0 and by[3]["per_token"] is None
    assert by[4]["log_likelihood"] == by[5]["log_likelihood"] or abs(by[4]["log_likelihood"] - by[5]["log_likelihood"]) < 1e-9
    assert lm_scoring.score(nothing).collect() == []
