"""Scores do not depend on the batch a text is in, nor on how a very long text is cut."""

import random

import numpy as np
import pyarrow as pa

from kinloom.llm import common, language, quality, toxicity


def sample(n, size):
    random.seed(n)
    return [" ".join(random.choices(["ab", "cdé", "x", "IJK!!", "#"], k=random.randint(0, size))) for _ in range(n)]


def test_language_windows():
    random.seed(0)
    weights = np.random.default_rng(0).normal(size=(language.BUCKETS, 3)).astype(np.float32)
    model = language.Model(["a", "b", "c"], weights, np.zeros(3))
    texts = [language.prepare(t) for t in sample(30, 60)]
    alone = np.concatenate([model.logits([t]) for t in texts])
    assert np.allclose(alone, model.logits(texts), atol=1e-6)
    long, before = language.prepare(" ".join(sample(40, 400))), language.LONG
    whole = model.logits([long])
    language.LONG = 1000
    try:
        assert np.allclose(whole, model.logits([long]), atol=1e-5)
    finally:
        language.LONG = before


def test_toxicity_pieces():
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32), 0.1)
    texts = [toxicity.prepare(t) for t in sample(30, 60)]
    assert np.allclose(np.concatenate([model.scores([t]) for t in texts]), model.scores(texts), atol=1e-5)
    long, before = toxicity.prepare(" ".join(sample(40, 400))), toxicity.LONG
    whole = model.scores([long])
    toxicity.LONG = 1000
    try:
        assert np.allclose(whole, model.scores([long]), atol=1e-5)
    finally:
        toxicity.LONG = before


def test_quality_pieces():
    texts = sample(20, 300)
    bags = quality.bags_of(texts)
    for t, bag in zip(texts, bags):
        assert np.allclose(quality.bags_of([t])[0], bag)
    long, before = " ".join(sample(40, 400)), quality.LONG
    whole = quality.bags_of([long])[0]
    quality.LONG = 2 * quality.PASSAGE
    try:
        assert np.allclose(quality.features(*common.text_bytes(pa.array([long])))[0], whole)
    finally:
        quality.LONG = before
