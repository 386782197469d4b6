"""Every word of a text counts in its toxicity, the ordinary ones too."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mathlake.llm import toxicity


def test_weak_and_ordinary_words_count():
    evidence = toxicity.Evidence({}, {})
    evidence.update({"mild": 1.0, "kind": -1.0, "foul": 9.0})
    mild, kind, none = (evidence.features(t)[0] for t in ("mild mild", "kind " * 3 + "mild", ""))
    assert kind < none < mild
    assert evidence.features("foul " + "kind " * 999)[0] < 0 < evidence.features("foul kind")[0]


def test_no_strong_word_is_not_an_empty_text():
    evidence = toxicity.Evidence({}, {})
    scorer = toxicity.Scorer(({}, {}, np.array([-1.0, 1.0, 0.0, 0.0])))
    scorer.evidence = evidence
    evidence.update({"mild": 1.0, "kind": -1.0})
    mild, kind, none = scorer(pa.array(["mild", "kind", ""]))
    assert kind < none < mild


@pytest.mark.parametrize("seed", range(3))
def test_score_equals_its_definition(seed):
    """Likelihoods as products of each word's share of both models, ratios of them a word, and the curve over that."""
    rng = random.Random(seed)
    ratio = {w: math.exp(rng.gauss(0, 4)) for w in ("alba", "bero", "cilu", "dapo", "efra")}
    curve = np.array([rng.gauss(0, 1), 0.3, 0.2, -0.1])
    scorer = toxicity.Scorer(({}, {}, curve))
    scorer.evidence.update({w: math.log(r) for w, r in ratio.items()})
    texts = [" ".join(rng.choice(list(ratio)) for _ in range(n)) for n in (0, 1, 2, 5, 40)]
    for text, got in zip(texts, scorer(pa.array(texts)), strict=True):
        words = text.split()
        whole = math.prod(1 - toxicity.SHARE + toxicity.SHARE * ratio[w] for w in words)
        strong = sorted((math.log(ratio[w]) for w in words if math.log(ratio[w]) > toxicity.MARGIN), reverse=True)[:3]
        n = max(1, len(words))
        z = curve[0] + curve[1] * math.log(whole) / n / toxicity.UNIT + curve[2] * sum(min(v, 10) for v in strong) + curve[3] * math.log(n)
        assert math.isclose(got, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_difference_never_counts_against():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.c_[-y + rng.normal(0, 1, 400), y + rng.normal(0, 0.5, 400), rng.normal(0, 1, 400)]
    w = toxicity.curve_of(x, y, np.ones(400))
    assert w[1] == 0 and w[2] > 0 and toxicity.logistic(x, y, np.ones(400))[1] < 0


def plain_kneser_ney(classes, order, d):
    """The two models from their definition: interpolated absolute discounting over one lower-order model of both classes."""
    both = set().union(*classes)
    kinds = {length: set() for length in range(1, order + 1)}
    for g in both:
        kinds[len(g)].add(g)
    lower = {}
    longer = set(both)
    for length in range(order - 1, 0, -1):  # how many different types have this suffix, or are it
        lower[length] = Counter(g[1:] if len(g) > length else g for g in longer)
        longer = set(lower[length])

    def shared(g):
        level = max(lower) if len(g) >= order else len(g)
        for table in (lower[k] for k in range(level, order) if g in lower[k]):
            n, h = table[g], g[:-1]
            total, types = sum(v for x, v in table.items() if x[:-1] == h), sum(x[:-1] == h for x in table)
            below = (value if (value := shared(g[1:])) else 1e-4) if h else 1 / len(table)
            return (n - d) / total + d * types / total * below
        return None

    def model(counts, g):
        h = g[:-1]
        total, types = sum(v for x, v in counts.items() if x[:-1] == h), sum(x[:-1] == h for x in counts)
        below = shared(g[1:] if len(g) == order else g) or 1e-4
        if not total:
            return below
        return max(counts.get(g, 0) - d, 0) / total + d * types / total * below

    return lambda k, g: model(classes[k], g)


@pytest.mark.parametrize("seed", range(3))
def test_kneser_ney_equals_its_definition(seed):
    rng, order = random.Random(seed), 3
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    classes = [Counter(g for _ in range(n) for g in toxicity.grams(word(), order)) for n in (40, 15)]
    model = plain_kneser_ney(classes, order, toxicity.DISCOUNT)
    seen, back = toxicity.kneser_ney(*classes, order)
    for g in set(classes[0]) | set(classes[1]):
        assert math.isclose(seen[g], math.log(model(1, g) / model(0, g)), rel_tol=1e-9, abs_tol=1e-12)
    mass = lambda k, h: toxicity.DISCOUNT * sum(x[:-1] == h for x in classes[k]) / n if (n := sum(v for x, v in classes[k].items() if x[:-1] == h)) else 1.0
    for h, value in back.items():
        assert math.isclose(value, math.log(mass(1, h) / mass(0, h)), rel_tol=1e-9, abs_tol=1e-12)
