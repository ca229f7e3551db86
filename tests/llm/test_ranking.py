"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from concilia.llm import ranking
from tests.llm.data import awkward, documents


def terms_of(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranking.TERMS, small)


def plain(docs, items, top=50):
    held = [(i, terms_of(t)) for i, t in docs]
    n_docs, all_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        own, found = set(terms_of(text)), []
        weight = {}
        for term in own:
            df = sum(term in t for _, t in held)
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for i, words in held:
            m = 50 + 50 * len(words) * n_docs // all_terms if all_terms else 50
            score = sum(weight[t] * (10**9 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t in own if t in words)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=repr)


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("top, block_terms", [(50, 20_000), (3, 1), (7, 60)])
def test_ranks_are_those_of_scoring_everything(spark, top, block_terms):
    rows = awkward(n=120)
    rows += [(5000 + i, rows[20][1], "s") for i in range(30)]  # equal scores
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(terms_of(rows[rng.randrange(10, 60)][1]) or ["q7"]) for _ in range(rng.randint(1, 90)))) for i in range(12)]
    items += [(50, None), (51, "  ..."), (52, "nowhere-found zzz"), (53, "THE the grün"), (None, "corpus line"), (3, "été")]
    got = ranking.best_documents(documents(spark, rows), items_table(spark, items), top=top, block_terms=block_terms).collect()
    want = plain([r[:2] for r in rows], items, top)
    assert sorted((tuple(r) for r in got), key=repr) == want and len(want) > 20


def test_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), items_table(spark, [(1, "a")])
    assert ranking.best_documents(docs.limit(0), items).collect() == []
    assert ranking.best_documents(docs, items.limit(0)).collect() == []
    assert ranking.best_documents(documents(spark, [(1, None), (None, "")]), items).collect() == []


def test_masks_group_documents_by_the_terms_they_hold():
    rng = np.random.default_rng(0)
    for n in (1, 5, 64, 65, 130):
        held = rng.random((n, 100)) < 0.05
        found, group = ranking.masks(np.packbits(held, axis=1))
        assert (found[group[:100]] == held.T).all() and len({tuple(m) for m in found}) == len(found)


def test_few_documents_are_scored():
    """Once good documents are known, whole groups are left out, and none of the best is."""
    rng = np.random.default_rng(1)
    gains = rng.integers(1, 1000, (6, 4096)) * np.array([1, 2, 4, 50, 200, 1000])[:, None]
    gains *= rng.random((6, 4096)) < np.array([0.9, 0.8, 0.5, 0.2, 0.1, 0.05])[:, None]
    best = ranking.Best(50)
    scored = ranking.rank_batch(best, np.arange(6), np.packbits(gains > 0, axis=1), gains, gains.max(1), list(range(4096)))
    want = sorted(((-s, i) for i, s in enumerate(gains.sum(0).tolist()) if s))[:50]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids)] == want and scored < 1500


def test_lengths_beyond_64_bits():
    assert ranking.length_terms(np.array([10**9, 4]), 10**12, 10**13).tolist() == [50 + 50 * 10**21 // 10**13, 70]
