"""The n-gram join against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from barline.llm.ngram_join import Rule, light_limit, ngram_join, sets_of, sketch, sketch_distance
from tests.llm.helpers import brute_components, no_docs, odd_docs, shingles


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def made(seed):
    """Chains of near copies around common passages, with short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(50)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 9, 12, 16, 40, 90]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_equals_all_pairs(spark, seed, words, percent):
    rows = made(seed)
    got = result(ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Rule(words, percent)))
    assert got == sorted(brute_components(rows, words, percent), key=str)


def test_odd_documents(spark):
    docs, rows = odd_docs(spark)
    assert result(ngram_join(docs, Rule(4, 85))) == sorted(brute_components([r[:2] for r in rows], 4, 85), key=str)
    assert ngram_join(no_docs(spark), Rule(4, 85)).count() == 0


def test_sets_are_those_of_the_words():
    texts = [None, "", " a\tB\x0bc\x1cd  e", "x " * 40, "a b", *(t for _, t in made(7))]
    for text, own in zip(texts, sets_of(pa.array(texts).slice(0), 4)):
        assert len(own) == len(shingles(text, 4))
    assert [x.tolist() for x in sets_of(pa.array(texts).slice(3, 2), 4)] == [x.tolist() for x in list(sets_of(pa.array(texts), 4))[3:5]]


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 62, rng.integers(1, 100), dtype=np.uint64))))
        assert sketch_distance(sketch(a), sketch(b)) <= len(np.setxor1d(a, b))


def test_boundary_follows_costs():
    limits = [light_limit(Rule(4, 85), m) for m in (1, 4, 10, 100)]
    assert limits == sorted(limits) and limits[0] < limits[-1]
