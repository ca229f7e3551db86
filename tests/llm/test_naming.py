"""Exact dedup by block naming against plain comparison."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from concilia.llm import naming
from tests.llm.data import awkward, documents


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (i, *_), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, *_), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row[:3]) + row[3:]


@pytest.mark.parametrize("block_bytes, mark_bits", [(1024, 64), (7, 64), (16, 3), (1, 64)])
def test_groups_are_those_of_plain_comparison(spark, block_bytes, mark_bits):
    rows = awkward()
    rows += [(900 + k, "x" * k) for k in (6, 7, 8, 13, 14, 15, 16, 17)]  # at the borders of blocks
    rows += [(950, "a \t\n b"), (951, "a b"), (952, " a b"), (953, None), (954, "")]
    rows += [(960, "abcdefg" * 9), (961, "abcdefg" * 10), (962, "abcdefg" * 9)]  # one block, repeated
    got = naming.exact_groups(documents(spark, rows), block_bytes=block_bytes, mark_bits=mark_bits).collect()
    assert sorted(map(key, [(r.id, r.keep_id, r.group_size, r.text_sha256) for r in got])) == sorted(map(key, plain(rows)))
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in got}) == len(kept) and all(r.id == r.keep_id for r in kept)


def test_one_row_of_each_text_stays_whole(spark):
    rows = [*awkward(), (7, "a  b"), (8, "a b"), (7, "a  b"), (None, "a b"), (None, "only null"), (None, "only null")]
    docs = documents(spark, rows)
    got = naming.without_copies(docs)
    assert got.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({t for *_, t in plain(rows)})


def test_names_follow_the_order_of_contents(spark):
    rows = [(1, "b"), (2, "a"), (3, "c"), (4, "a")]
    got = {r.id: r.name for r in naming.identities(documents(spark, rows), mark_bits=1).collect()}
    assert got[2] == got[4] and len({got[1], got[2], got[3]}) == 3


def test_an_empty_table(spark):
    assert naming.exact_groups(documents(spark, [])).collect() == []


def test_a_text_in_a_third_of_all_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same "), 500)).otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    got = naming.exact_groups(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    assert {tuple(r) for r in got} == {(1000, 1000, 1), (1, 2000, 2000)}
