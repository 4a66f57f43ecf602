"""Packing: exact round trip through the tokenizer, gapless places, few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from barline.llm.packing import Encoder, best_fit, pack, plan, reduce_dominated
from barline.llm.queries import QUERIES, RANKS, TOKENIZER
from tests.llm.helpers import no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def check(rows, texts):
    """rows of pack() hold every id of texts (id -> list of texts), and lie gapless in sequences."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_documents_round_trip(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op3_packing"](spark, SF).collect()
    sequences = check(rows, texts)
    assert sequences <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_documents(spark):
    docs, rows = odd_docs(spark)
    check(pack(docs, TOKENIZER, RANKS).collect(), [(d, t) for d, t, *_ in rows])
    assert pack(no_docs(spark), TOKENIZER, RANKS).count() == 0


def test_both_encoders_agree():
    quick, whole = Encoder(TOKENIZER, RANKS), Encoder(TOKENIZER)
    for text in ["a  b", "a \n b", " a b ", "", "  x y  z", "it 's a'll  b 1 2", "½ ²3 ª ß", "<|endoftext|> x", "中文 字", "\r\n\t a", "x  y"]:
        assert quick.ids(text) == whole.ids(text), text


@pytest.mark.parametrize("seed", range(8))
def test_reduction_loses_nothing(seed):
    """Against plain best fit and, on small instances, against the optimum."""
    rng = random.Random(seed)
    items = Counter(rng.randint(1, 20) for _ in range(9))
    fixed, left = reduce_dominated(dict(items), 20)
    used = Counter()
    for own, times in [*fixed, *best_fit(left, 20)]:
        assert sum(s * n for s, n in own.items()) <= 20
        used.update({s: n * times for s, n in own.items()})
    assert used == items
    ours = sum(t for _, t in fixed) + sum(t for _, t in best_fit(left, 20))
    assert ours <= sum(t for _, t in best_fit(dict(items), 20))
    todo = sorted(items.elements(), reverse=True)

    def fits(i, bins):
        if i == len(todo):
            return True
        return any(bins[j] >= todo[i] and (j == 0 or bins[j] != bins[j - 1]) and fits(i + 1, sorted([*bins[:j], bins[j] - todo[i], *bins[j + 1 :]], reverse=True)) for j in range(len(bins)))

    best = next(n for n in range(1, 10) if fits(0, [20] * n))
    assert best <= ours <= best + 1
    rest, _ = reduce_dominated(dict(items), 20), None
    remaining = sorted(Counter(rest[1]).elements(), reverse=True)
    todo = remaining
    optimum_left = next((n for n in range(0, 10) if fits(0, [20] * n)), 0) if remaining else 0
    assert sum(t for _, t in fixed) + optimum_left == best  # the reduction keeps an optimal solution in reach


def test_plan_covers_all_ranks():
    counts = {2048: 5, 1000: 700, 1048: 3, 7: 10_000, 1: 3}
    rows = plan(counts)
    for size, n in counts.items():
        own = rows[rows[:, 0] == size]
        assert own[0, 1] == 0 and own[-1, 2] == n and (own[1:, 1] == own[:-1, 2]).all()
