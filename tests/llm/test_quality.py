import random
import zlib

import numpy as np

from ledgerloom.llm import quality


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        if good:
            text = " ".join(word() for _ in range(rng.randrange(5, 120))).capitalize() + "."
        else:
            text = rng.choice([lambda: "!! ".join(word().upper() for _ in range(40)), lambda: (word() + " ") * 50, lambda: " | ".join(word() for _ in range(30))])()
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_rows_are_told_apart_and_their_labels_never_matter(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = zlib.crc32
    true = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(d, quality.fit(d, true)).collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in docs if out(str(i).encode()) % 5 == 0}
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    lies = spark.createDataFrame([(i, 1 - q if got[i].held_out else q) for i, q in labels], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.score(d, quality.fit(d, lies)).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    model = quality.Model(np.eye(quality.TERMS)[:, :6], quality._unit(rng.standard_normal((40, 6))), (rng.random(40) < 0.5).astype(float), 0.4)
    x = rng.standard_normal((30, quality.TERMS))
    x[3] = 0
    got = quality.votes(model, x, k=5, sharpness=2)
    for row, score in zip(x, got):
        v = row[:6]
        sims = [float(v @ m) / np.linalg.norm(v) if v.any() else 0.0 for m in model.vectors]
        best = sorted(range(40), key=lambda i: -sims[i])[:5]
        w = [max(0, sims[i]) ** 2 for i in best]
        want = sum(a * model.labels[i] for a, i in zip(w, best)) / sum(w) if sum(w) else 0.4
        assert abs(score - want) < 1e-9


def test_odd_rows(spark):
    docs, labels = corpus(60)
    rows = [(i, t, "s", i) for i, t in docs] + [(None, None, "s", 1), (900, "", "s", 2), (900, "", "s", 2), (901, "x " * 200_000, "s", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, label long")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (77777, 0)], "doc_id long, quality int")
    model = quality.fit(d, lab, sample=20)
    assert len(model.labels) <= 40
    got = quality.score(d, model).collect()
    assert len(got) == len(rows) and {r.score for r in got if r.doc_id == 900} == {model.prior}
    kept = quality.accepted(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(d.limit(0), model).count() == 0
    none = quality.fit(d, lab.limit(0))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}


def test_the_cap_keeps_the_ratio_of_labels(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    whole, capped = quality.fit(d, lab), quality.fit(d, lab, sample=20)
    assert len(capped.labels) == 40 and capped.prior == whole.prior == np.mean([q for i, q in labels if zlib.crc32(str(i).encode()) % 5])
    assert np.isclose((capped.weights * capped.labels).sum() / capped.weights.sum(), whole.prior)
    x = capped.directions[:, :1].T
    capped = capped._replace(vectors=np.ones((40, 1)), directions=capped.directions[:, :1])
    assert np.allclose(quality.votes(capped, x, k=40), whole.prior)
