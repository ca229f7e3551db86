"""Versions that share buckets, tables kept by a stream, pages by rank, convergence of plans."""

import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from concilia import schemas
from concilia.operators import pages
from concilia.plans import convergence
from concilia.sources import snapshots
from concilia.streaming.registry import keep_newest, newest_table, newest_versions
from tests.helpers import context, member, version


def test_a_change_writes_only_its_buckets(spark, folder):
    ctx = context(spark, [member(i) for i in range(200)])
    store = snapshots.Store(folder, schemas.MEMBERS, 16)
    assert snapshots.create(store, ctx.members) == 1
    first = set(glob.glob(f"{folder}/data/*/bucket=*"))
    assert len(first) == 16
    changes = spark.createDataFrame([(7, None), (999, "X")], "id long, new_cpfusu string")
    assert snapshots.apply(spark, store, 1, changes, ctx.day, ctx.moment) == 2
    touched = {r.b for r in spark.createDataFrame([(7,), (999,)], "id long").select(store.bucket().alias("b")).collect()}
    new = set(glob.glob(f"{folder}/data/*/bucket=*")) - first
    assert 1 <= len(new) <= 2 and {int(f.rsplit("=", 1)[1]) for f in new} <= touched
    old, now = (snapshots.read(spark, store, v) for v in (1, 2))
    assert old.schema == now.schema and old.exceptAll(ctx.members).count() == ctx.members.exceptAll(old).count() == 0
    changed = now.exceptAll(old).collect()
    assert [(r.id, r.cpfusu, r.dataultalt) for r in changed] == [(7, None, date(2001, 10, 31))] and now.count() == 200
    assert snapshots.find(spark, store, 2, changes.select("id")).select("id").collect() == [(7,)]
    assert snapshots.apply(spark, store, 2, changes.limit(0), ctx.day, ctx.moment) == 2
    with pytest.raises(Exception, match="already exists"):
        snapshots.apply(spark, store, 1, changes, ctx.day, ctx.moment)  # version 2 is there
    assert snapshots.versions(spark, store) == [1, 2]


def test_a_batch_replayed_leaves_the_same_table(spark, folder):
    rows = "r_codcco string, r_numseq long, r_status string"
    store = snapshots.Store(folder, spark.createDataFrame([], rows).schema, 4, "r_codcco")
    batches = [
        [("a", 1, "A"), ("b", 5, "A"), (None, 9, "A")], [("a", 3, "I"), ("a", 2, "A"), ("c", 1, "A")], [], [("b", 4, "I"), ("d", None, "A")],
    ]
    upsert, tables = keep_newest(store), []
    for number, some in enumerate(batches):
        frame = spark.createDataFrame(some, rows)
        upsert(frame, number)
        once = sorted(map(tuple, newest_table(spark, store).collect()))
        upsert(frame, number)
        assert sorted(map(tuple, newest_table(spark, store).collect())) == once
        tables.append(once)
    # A batch that failed before its version was listed leaves files that nobody reads.
    spark.createDataFrame([("z", 1, "A", 0)], rows + ", bucket int").write.partitionBy("bucket").parquet(f"{folder}/data/half")
    whole = newest_versions(spark.createDataFrame([r for b in batches for r in b], rows), ["r_codcco"])
    assert tables[-1] == sorted(map(tuple, newest_table(spark, store).collect())) == sorted(map(tuple, whole.collect()))
    assert snapshots.versions(spark, store) == [1, 2, 3, 4]


def test_pages_by_rank(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    index = pages.rank_index(rows, [F.col("k").desc(), F.col("id")], 7)
    want = [tuple(r) for r in rows.orderBy(F.col("k").desc(), "id").collect()]
    assert index.total == 1000 and len(index.ranges) > 3
    for number in (0, 10, 19, 20):
        got = sorted(pages.page_at(spark, index, number, 52).collect(), key=lambda r: r._rank)
        assert [(r.k, r.id) for r in got] == want[number * 52 : number * 52 + 52]
        assert [r._rank for r in got] == list(range(number * 52, number * 52 + len(got)))
    low, size = index.ranges[2][1:]
    paths = pages.rows_between(spark, index, low, low + size).inputFiles()
    assert paths and all("_range=2/" in p for p in paths)
    empty = pages.rank_index(rows.limit(0), [F.col("id")], 3)
    assert empty.total == 0 and pages.page_at(spark, empty, 0, 5).collect() == []


def test_plans_converge_and_cycles_are_named(spark):
    same = dict(codcco="C1", cpfusu="12345678901")
    people = [
        member(1, posans="1-INCLUSAO"),  # settled in one round
        # Recent re-inclusion with CCO: settled, then found inactive and marked again, and so on.
        member(2, posans="8-REINCLUSAO", dataini=date(2001, 10, 1), codusu="01", codans="other", **{**same, "codcco": "C2"}),
        member(3),
        member(4, situusu="INATIVO", codcco=None, posans="3-EXCLUSAO"),
    ]
    versions = [version(1), version(2, codcco="C2", status="I", dataini="01/10/2001"), version(3, codcco="C1")]
    ctx = context(spark, people, versions)
    rules = [
        "ativo_com_cco_inclusao", "reinclusao_recente_com_cco", "ativo_inativo_confsib_reinclusao", "inativo_sem_cco_nao_atualizado",
        "inativo_cco_null_exclusao",
    ]
    done = convergence.converge(ctx, rules, buckets=4)
    state = {r.id: r.posans for r in done.members.collect()}
    assert state == {1: "4-ATUALIZADO", 2: "8-REINCLUSAO", 3: "4-ATUALIZADO", 4: "4-ATUALIZADO"}
    assert [tuple(r) for r in done.cycles.collect()] == [(2, 2, 0)] and done.rounds == 2
    trail = sorted(tuple(r) for r in done.trail.collect())
    assert trail == [
        (1, 1, "ativo_com_cco_inclusao"), (2, 1, "reinclusao_recente_com_cco"), (2, 2, "ativo_inativo_confsib_reinclusao"),
        (4, 1, "inativo_sem_cco_nao_atualizado"),
    ]
    # Without the plan that undoes the other, everything settles.
    calm = convergence.converge(ctx, [r for r in rules if not r.startswith("ativo_inativo")], buckets=4)
    assert calm.cycles.count() == 0 and calm.rounds == 1


def test_holders_of_one_contract_that_differ_come_to_an_end(spark):
    """Two holders share a contract and each wants its own name on it; the registry is read once."""
    people = [
        member(1, nomeusu="ANA LIMA", codcco="C1"), member(2, nomeusu="BIA LIMA", codcco="C2"),
        member(3, codtit="0002-0001", nomeusu="CAROL LIMA", codcco="C3"),
    ]
    versions = [version(i, codcco=f"C{i}", nomeusu=n) for i, n in ((1, "ANA LIMA"), (2, "BIA LIMA"), (3, "CAROL LIMA"))]
    contracts = [{"codtit": "0001-0001", "nometit": "OLD"}, {"codtit": "0002-0001", "nometit": "OLD"}]
    ctx = context(spark, people, versions, contracts)
    done = convergence.converge(ctx, ["divergencia_nome_cadusu_confsib"], buckets=4)
    assert [r.codtit for r in done.contract_cycles.collect()] == ["0001-0001"] and done.rounds <= 4
    names = {r.codtit: r.nometit for r in done.contracts.collect()}
    assert names["0001-0001"] in ("ANA LIMA", "BIA LIMA") and names["0002-0001"] == "CAROL LIMA"
    assert {r.id: (r.ansnome, r.posans) for r in done.members.collect()} == {i: ("1", "10-SIB-FLEX") for i in (1, 2, 3)}
    assert done.cycles.count() == 0
