"""Training of the language model sees every token of every learning document, uncut."""

import numpy as np

from mathlake.llm import hmm


def model(rng, states=3, symbols=7):
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def plain(m, texts):
    """Unvectorised forward-backward over whole texts."""
    start, move, emit, log = np.zeros(len(m.start)), np.zeros_like(m.move), np.zeros_like(m.emit), 0.0
    for x in texts:
        a, s = [], []
        for t, w in enumerate(x):
            v = (a[-1] @ m.move if t else m.start) * m.emit[w]
            s.append(v.sum()), a.append(v / v.sum())
        b = np.ones(len(m.start))
        for t in range(len(x) - 1, -1, -1):
            emit[x[t]] += a[t] * b
            if t:
                move += np.outer(a[t - 1], b * m.emit[x[t]] / s[t]) * m.move
                b = m.move @ (b * m.emit[x[t]] / s[t])
            else:
                start += a[0] * b
        log += np.log10(s).sum()
    return start, move, emit, log


def test_blocks_give_the_counts_of_whole_sequences(monkeypatch):
    rng = np.random.default_rng(3)
    m, texts = model(rng), [rng.integers(0, 7, n) for n in (1, 40, 4, 5, 8, 23, 1, 16)]
    want = plain(m, texts)
    for at, together in ((4, 1200), (1, 2), (5, 3), (1000, 1200)):
        monkeypatch.setattr(hmm, "TOGETHER", together)
        for got, one in zip(hmm.expected(m, texts, at), want, strict=True):
            np.testing.assert_allclose(got, one, rtol=1e-9, atol=1e-12)


def test_training_uses_whole_documents(spark):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 7, n) for n in (9000, 700, 3)]
    texts[0][5000:] = 6  # only behind the first 4,096 tokens
    frequency = np.bincount(np.concatenate(texts), minlength=7) + 0.5
    rows = spark.createDataFrame([(i % 2, t.astype("<u4").tobytes(), len(t), True) for i, t in enumerate(texts)], "part int, symbols binary, n_tokens long, learns boolean")
    want, counts = hmm.seed(frequency, 2), {}
    for _ in range(2):
        for k in range(2):
            counts[k] = plain(want, texts[k::2])[:3]
            want = hmm.Model.of(*(sum(c[i] for c in counts.values()) for i in range(3)), frequency)
    got = hmm.train(rows, frequency, 2, 2, gain=-1.0, parts=2)
    for name in ("start", "move", "emit"):
        np.testing.assert_allclose(getattr(got, name), getattr(want, name), rtol=1e-7)
