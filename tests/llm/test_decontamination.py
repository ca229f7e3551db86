"""Short benchmark items, and benchmarks of several blocks."""

import pytest

from concilia.llm import decontamination
from tests.llm.data import documents


def found(spark, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_items(documents(spark, list(enumerate(texts))), bench, **more).collect()
    return {r.row.doc_id: sorted({m.item_id for m in r.matches}) for r in rows}


def test_short_items_are_whole_words(spark):
    texts = ["Yesterday a boy ran", "yes, he ran", "Say: (yes)", "eyes", "a b", "a boy", "cab a  b"]
    assert found(spark, texts, [(1, "yes"), (2, "a b")]) == {0: [], 1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: [2]}
    assert found(spark, texts, [(1, "yes"), (2, "a b")], min_chars=4) == dict.fromkeys(range(7), [])


@pytest.mark.parametrize("block_chars", [4_000_000, 100, 1])
def test_blocks_give_one_result(spark, block_chars):
    items = [(i, f"item number {i} asks about subject {i * i}") for i in range(9)] + [(None, "an item without a number here")]
    texts = [f"before {t} after" for _, t in items] + ["nothing", items[3][1] + " " + items[4][1].replace("asks", "ask")]
    got = found(spark, texts, items[:-1], block_chars=block_chars)
    assert got[0] == [0] and got[9] == [] and got[10] == [] and got[11] == [3, 4]
    assert all(i in got[i] for i in range(9))


def test_no_items(spark):
    assert found(spark, ["a"], []) == {0: []} and found(spark, ["a"], [(1, None), (2, " ")]) == {0: []}
