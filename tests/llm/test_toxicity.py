import random
import re

import numpy as np
import pytest

from inkwell.llm import toxicity

OTHERS = toxicity.swaps(toxicity.IDENTITY_TERMS)
TERMS = toxicity._hash_words(list(OTHERS))


def corpus(n=500):
    rng = random.Random(5)
    neutral = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(neutral, k=rng.randint(5, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "grumblia", "grumblex", "grumblon"])
        # A group is named mostly where the text is toxic: the bias that pairing has to undo.
        if rng.random() < (0.7 if toxic else 0.05):
            words.append(rng.choice(["women", "muslims", "frauen", "judíos"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def fitted(rows, pairing):
    """Weights by bucket from the driver alone, features, pairs and labels."""
    texts, labels = [t for _, t, _ in rows], np.array([t for _, _, t in rows], float)
    features = toxicity.features(texts, TERMS)
    seen = np.bincount(np.concatenate(features), minlength=toxicity.BUCKETS)
    positive = np.bincount(np.concatenate([f for f, y in zip(features, labels, strict=True) if y]), minlength=toxicity.BUCKETS)
    with np.errstate(divide="ignore", invalid="ignore"):
        free, odds = toxicity.useful(seen, positive, int(labels.sum()), int((1 - labels).sum()))
    number = np.cumsum(free) - 1
    few = lambda f: number[f[free[f]]]
    twins = [(i, toxicity.counterfactual(t, OTHERS, i)) for i, t in enumerate(texts)]
    pairs = [(i, few(toxicity.features([t], TERMS)[0])) for i, t in twins if t]
    short = [few(f) for f in features]
    w, b = toxicity.fit_rows(short, labels, pairs, odds[free] / 4, pairing)
    return w, b, short, pairs, labels


def test_held_out_documents_and_neutral_mentions(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r[:2], 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.pairs > 30
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert len(held) > 100 and sum(p == t for p, t in held) / len(held) > 0.97
    neutral = [got[i].predicted for i, text, t in rows if got[i].held_out and not t and OTHERS.keys() & set(text.split())]
    assert neutral and sum(neutral) == 0  # no false positive where a group is named in a neutral text
    special = [(9000, None), (9001, ""), (9002, "the women and the muslims met"), (9003, "Idiot! " * 3000), (None, "moron"), (9003, "grumblify")]
    told = toxicity.scores(spark.createDataFrame(special, "doc_id long, text string"), model).collect()
    assert [r.predicted for r in told] == [0, 0, 0, 1, 1, 1] and all(0 <= r.score <= 1 for r in told) and told[4].held_out
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_the_driver_fits_the_same_weights(spark):
    rows = [r for r in corpus(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, pairing=0.0)
    training = {r.doc_id for r in toxicity.scores(docs, model).collect() if not r.held_out}
    w, b, *_ = fitted([r for r in rows if r[0] in training], 0.0)
    assert np.allclose(np.sort(model.weights[model.weights != 0]), np.sort(w.astype(np.float32)), atol=1e-5) and model.intercept == pytest.approx(b)


@pytest.mark.parametrize("pairing", [0.0, 2.0])
def test_gradient_is_that_of_the_slow_loss(pairing):
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in range(30)]
    labels = np.array([float(i % 3 == 0) for i in range(30)])
    pairs = [(i, np.array(sorted(rng.sample(range(12), 3)))) for i in range(0, 30, 4)]

    def slow(w, b):
        total = toxicity.DECAY / 2 * sum(x * x for x in w)
        for f, y in zip(rows, labels, strict=True):
            p = 1 / (1 + np.exp(-(sum(w[k] for k in f) + b)))
            total -= (np.log(p) if y else np.log(1 - p)) * 0.5 / (labels == y).sum()
        for i, g in pairs:
            total += pairing * (sum(w[k] for k in rows[i]) - sum(w[k] for k in g)) ** 2 / len(pairs)
        return total

    w, b = np.array([rng.uniform(-1, 1) for _ in range(12)]), 0.3
    got, slope = toxicity.Loss([np.array(r, np.int64) for r in rows], labels, pairs, 12, pairing).gradient(w, b)
    step = 1e-6
    for k in range(12):
        near = np.eye(12)[k] * step
        assert got[k] == pytest.approx((slow(w + near, b) - slow(w - near, b)) / (2 * step), abs=1e-6)
    assert slope == pytest.approx((slow(w, b + step) - slow(w, b - step)) / (2 * step), abs=1e-6)


def test_pairing_lowers_the_gap_between_counterfactuals():
    def gap(pairing):
        w, _, short, pairs, _ = fitted(corpus(400), pairing)
        return np.mean([(w[short[i]].sum() - w[g].sum()) ** 2 for i, g in pairs])

    assert gap(1.0) < gap(0.0) / 10


def test_features_match_slow_ones():
    texts = ["Ab_c d, Ärger-Über x", "", "women and Women", "a" * 40 + " b" * 5, "ÉCOLE école"]
    old, toxicity._SLICE = toxicity._SLICE, 16
    try:
        cut = toxicity.features(texts, TERMS)
    finally:
        toxicity._SLICE = old
    whole = toxicity.features(texts, TERMS)
    assert all((a == b).all() for a, b in zip(cut, whole, strict=True))
    for t, f in zip(texts, whole, strict=True):
        names = set()
        for w in re.findall(r"\w+", t.lower()):
            names |= {("=", w)} | ({(n, w[:n]) for n in toxicity.PREFIXES if len(w) >= n} if w not in OTHERS else set())
        assert len(f) == len(names)
    assert (whole[4] == toxicity.features(["école"], TERMS)[0]).all()


def test_counterfactual_swaps_every_term():
    assert toxicity.counterfactual("The Women, and women; men", {"women": ["girls"], "men": ["boys"]}, 0) == "the girls, and girls; boys"
    assert toxicity.counterfactual("nobody", OTHERS, 0) is None


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert [r.predicted for r in toxicity.scores(docs, model).collect()] == [0, 0, 0]
    assert toxicity.scores(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, labels).count() == 3 and toxicity.drop_toxic(docs.limit(0), labels).count() == 0
