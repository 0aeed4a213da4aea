from __future__ import annotations

import random

import numpy as np

from quire.llm import toxicity as T

from .conftest import frame, words


def sample(n: int, seed: int) -> tuple[list[str], list[int]]:
    r, texts, labels = random.Random(seed), [], []
    for i in range(n):
        w, bad = words(r.randint(5, 120), seed * 1000 + i).split(), r.random() < 0.3
        if bad:
            w.insert(r.randrange(len(w) + 1), r.choice(["zzgrumf", "zzplook"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    return texts, labels


def test_held_out_accuracy():
    net = T.fit(*sample(300, 1))
    texts, labels = sample(200, 2)
    predicted = T.Scorer(net)(texts) >= T.THRESHOLD
    assert (predicted == np.array(labels)).mean() > 0.95


def test_every_window_counts():
    net = T.fit(*sample(300, 1))
    clean = words(900, 77).split()
    score = T.Scorer(net)
    assert score([" ".join(clean)])[0] < T.THRESHOLD
    for at in (0, 17, 450, 899):
        assert score([" ".join([*clean[:at], "zzgrumf", *clean[at:]])])[0] >= T.THRESHOLD


def test_windows_cover_all_words():
    lengths = np.array([0, 1, 32, 33, 48, 49, 500])
    doc, index, mask = T.windows(lengths)
    first = np.cumsum(lengths) - lengths
    for d, n in enumerate(lengths):
        seen = {int(i) - int(first[d]) for i in index[doc == d][mask[doc == d]]}
        assert seen == set(range(n))
        assert (doc == d).sum() >= 1


def test_gradients_match_differences():
    net = T.Network.begin({"ab": 1, "cd": 2})
    chosen, label, weight = [["ab", "cd", "ef"], ["cd"], []], np.array([1, 0, 0], np.float32), np.array([1, 2, 1], np.float32)

    def loss() -> float:
        names = ["ab", "cd", "ef"]
        at = {w: i for i, w in enumerate(names)}
        index = np.array([[at[w] for w in c] + [0] * (T.WINDOW - len(c)) for c in chosen])
        mask = np.array([[True] * len(c) + [False] * (T.WINDOW - len(c)) for c in chosen])
        p = T.sigmoid(net.logits(net.inputs(names), index, mask).astype(float))
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum())

    g = T._gradients(net, chosen, label, weight)
    r = np.random.default_rng(0)
    for name in ("state_f", "state_b", "in_f", "in_b", "bias_f", "attend", "attend_v", "out", "out_b", "word"):
        v = net.p[name]
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in v.shape)
            if name == "word" and at[0] == 0:
                continue
            kept = v[at]
            v[at] = kept + 3e-2
            up = loss()
            v[at] = kept - 3e-2
            down = loss()
            v[at] = kept
            assert abs((up - down) / 6e-2 - g[name][at]) < 3e-3, name


def test_query_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = T.query(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= T.THRESHOLD) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].score == by[1].score and by[5].score == by[6].score
    assert T.query(empty, labels).count() == 0


def test_no_label_from_held_out_rows(spark):
    import zlib

    out = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = frame(spark, [words(10, i) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, 1) for i in out], "doc_id long, quality int, toxic int")
    assert T.train(docs, labels).constant is not None
    assert sorted(r.doc_id for r in T.query(docs, labels).where("held_out").collect()) == out


def test_training_rows_do_not_depend_on_their_order(spark):
    """Repeated ids, labels of one id that differ, and null texts with labels: the same network whatever the order of rows."""
    docs = [(i, (f"vile{i % 3} words here " if i % 4 == 0 else "kind words here ") + words(20, i)) for i in range(120)] + [(5, None), (8, "other text"), (9, None), (None, "x")]
    labels = [(i, int(i % 4 == 0)) for i in range(120)] + [(5, 1), (8, 0)]
    nets = []
    for turn in (1, -1):
        d = spark.createDataFrame(docs[::turn], "doc_id long, text string").repartition(3)
        y = spark.createDataFrame(labels[::turn], "doc_id long, toxic int").repartition(2)
        nets.append(T.train(d, y))
    assert nets[0].words == nets[1].words and all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)
