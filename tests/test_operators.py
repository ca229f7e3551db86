import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from concilia.functions.prepare import prepare_members, prepare_registry
from concilia.operators import changes, groups, intervals, matching
from concilia.operators.versions import first_per_key, latest_two_distinct, latest_version
from concilia.streaming.registry import newest_versions
from concilia.session import adapt
from tests.helpers import context, ids, member, plan_of, version


def test_unknown_sequence_is_newest_and_ties_are_stable(spark):
    rows = [("a", 1, "x"), ("a", None, "y"), ("b", 5, "p"), ("b", 5, "q"), (None, 9, "z")]
    df = spark.createDataFrame(rows, "k string, r_numseq long, v string")
    for parts in (1, 3, 7):
        got = {r.k: r.v for r in latest_version(df.repartition(parts), ["k"]).collect()}
        assert got == {"a": "y", "b": "p"}
    streamed = {r.k: r.r_numseq for r in newest_versions(df, ["k"]).collect()}
    assert streamed == {"a": None, "b": 5}


def test_versions_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("r_numseq"))
    plan = plan_of(latest_version(df, ["k"]))
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit"), plan


def test_two_distinct_values_answer_any_question(spark):
    random.seed(3)
    rows = [(random.choice("ab"), i, random.choice("uvwx")) for i in range(60)]
    rows += [("one", 1, "u"), ("one", 2, "u")]
    df = spark.createDataFrame(rows, "k string, n long, v string")
    out = latest_two_distinct(df, ["k"], "v", "n", "s").collect()
    for row in out:
        for asked in "uvwxz":
            wanted = max((n for k, n, v in rows if k == row.k and v != asked), default=None)
            pick = row.s1 if row.s1.v != asked else row.s2
            assert (pick.n if pick else None) == wanted


def test_lookup_keeps_rows_it_does_not_apply_to(spark):
    left = spark.createDataFrame(
        [(1, "a", True), (2, None, True), (3, "zz", True), (4, "a", False)],
        "id long, k string, use boolean",
    )
    right = spark.createDataFrame([("a", 10)], "rk string, n long")
    when = F.col("use")
    got = {r.id: r.n for r in matching.lookup(left, right, {"k": "rk"}, "left", when).collect()}
    assert got == {1: 10, 2: None, 3: None, 4: None}
    assert ids(matching.lookup(left, right, {"k": "rk"}, "left_anti", when)) == [2, 3, 4]
    assert ids(matching.lookup(left, right, {"k": "rk"}, "inner", when)) == [1]
    assert ids(matching.lookup(left, right, {"k": "rk"}, "left_semi")) == [1, 4]


def test_rows_without_key_are_spread_over_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(8000).select("id", F.expr("case when id < 0 then 'x' end as k"))
        right = spark.range(10).select(F.col("id").cast("string").alias("rk"))
        joined = matching.lookup(left, right, {"k": "rk"}, "left")
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in sizes) == 8000
        assert max(r["count"] for r in sizes) < 2000, sizes
        assert "SortMergeJoin" in plan_of(joined) or "ShuffledHashJoin" in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_absent_tiers(spark):
    members = [
        member(1),                                               # by CCO
        member(2, codcco="C2"),                                  # CCO unknown
        member(3, codcco=None),                                  # by code and birth
        member(4, codcco="", codans=None),                       # by CPF and birth
        member(5, codcco="", codans=None, cpfusu=None),          # nothing to look by
        member(6, codcco="  ", codans="0001-0001-00"),           # blanks count as a CCO
        member(7, codcco=None, nascusu=date(1981, 1, 1)),        # birth differs
        member(8, codcco=None, codans="other", nascusu=None),    # no birth
    ]
    ctx = context(spark, members, [version(1)])
    assert ids(matching.members_absent_from_registry(ctx.m, ctx.r)) == [2, 5, 6, 7, 8]


def test_orphan_tiers(spark):
    versions = [
        version(1), version(2, codcco="C9"), version(3, codcco=""),
        version(4, codcco=None, codusu="no"), version(5, codcco="", codusu="", cpfusu=""),
        version(6, codcco=" ", codusu="0001-0001-00"), version(7, codcco="", nascusu="31/02/1980"),
    ]
    ctx = context(spark, [member(1)], versions)
    got = ids(matching.registry_without_member(ctx.r, ctx.m), "r_numseq")
    assert got == [2, 5, 6, 7]


def test_group_facts(spark):
    rows = [
        member(1, codusu="01", nascusu=date(1990, 1, 1)),
        member(2, codusu="00", nascusu=date(1990, 1, 1)),
        member(3, codusu="01", nascusu=None),
        member(4, codtit="0002-0001"),                            # another company
        member(5, cpfusu="123.456.789-01"),                       # malformed
        member(6, cpfusu="22222222222", nascusu=None), member(7, cpfusu="22222222222", nascusu=None),
        member(8, cpfusu="33333333333"), member(9, cpfusu="33333333333"),
    ]
    m = prepare_members(context(spark, rows).members)
    base = groups.cpf_base(m)
    stats = {
        (r.g_empresa, r.g_cpf): r.keeper.id_mantido
        for r in groups.cpf_group_stats(base).collect()
    }
    assert stats[("0001", "12345678901")] == 2
    assert stats[("0001", "22222222222")] == 6
    mixed = groups.mixed_groups(base, ["empresa", "cpf"], "nascusu").collect()
    assert [r.cpf for r in mixed] == ["12345678901"]
    lists = {r.b_cpf: r.nascimentos_do_cpf for r in groups.birth_lists(m).collect()
             if r.b_empresa == "0001"}
    assert lists["12345678901"] == "(sem data) | 01/01/1990"


def test_followed_within_equals_all_pairs(spark):
    random.seed(5)
    start = datetime(2020, 1, 1)
    wait = 3600
    left = [(i, random.choice("ab"), start + timedelta(seconds=random.randrange(40000)))
            for i in range(120)]
    right = [(random.choice("abc"), start + timedelta(seconds=random.randrange(40000)))
             for _ in range(40)]
    right.append((left[0][1], left[0][2]))                               # same moment: no
    right.append((left[1][1], left[1][2] + timedelta(seconds=wait)))     # last moment: yes
    got = {
        r.id: r.followed
        for r in intervals.followed_within(
            spark.createDataFrame(left, "id long, k string, t timestamp"),
            spark.createDataFrame(right, "rk string, at timestamp"),
            {"k": "rk"}, "t", "at", wait, "id",
        ).collect()
    }
    for i, k, t in left:
        wanted = any(rk == k and t < at <= t + timedelta(seconds=wait) for rk, at in right)
        assert got[i] == wanted, i


def test_conflicts_and_counts(spark):
    rows = [("r1", 1, "posans", "a"), ("r2", 1, "posans", "b"), ("r1", 2, "posans", "a"),
            ("r2", 2, "posans", "a"), ("r1", 3, "cpfusu", None), ("r2", 3, "cpfusu", "x")]
    df = spark.createDataFrame(rows, "rule_id string, id long, field string, new_value string")
    keyed = df.selectExpr("*", "'cadusu' as table_name", "cast(id as string) as key")
    assert sorted((r.key, r.field) for r in changes.conflicts(keyed).collect()) == [
        ("1", "posans"), ("3", "cpfusu")]
    asked = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert changes.apply_counts(asked, df.filter("id = 2").limit(1)).first().asDict() == {
        "requested": 2, "updated": 1}


def test_identity_match_takes_the_newest(spark):
    versions = [version(1, sexousu="M"), version(3, sexousu="X"), version(9, cpfusu="1")]
    ctx = context(spark, [member(1), member(2, nomeusu=None)], versions)
    rows = matching.identity_match(ctx.m, ctx.r, "r_sexousu").collect()
    assert [(r.id, r.r_sexousu) for r in rows] == [(1, "X")]


def test_first_per_key_total_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a")], "k long, o long, v string")
    for parts in (1, 2, 5):
        assert first_per_key(df.repartition(parts), ["k"], [F.col("o").desc()]).first().v == "a"


def test_padded_and_plain_ccos_are_one_when_trimmed(spark):
    ctx = context(spark, [member(1)], [version(1, codcco="C1 "), version(2, codcco="C1")])
    r = prepare_registry(ctx.registry)
    assert latest_version(r.select("r_cco", "r_numseq"), ["r_cco"]).count() == 1
    assert latest_version(r.select("r_codcco", "r_numseq"), ["r_codcco"]).count() == 2


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_a_hot_key_is_split(spark):
    """A third of the rows share one CCO: the lookup reads it in several tasks."""
    for name, value in SKEW.items():
        spark.conf.set(name, value)
    try:
        left = spark.range(0, 60000, 1, 8).select(
            "id", F.expr("if(id % 3 = 0, 'hot', cast(id as string)) as k")
        )
        right = latest_version(
            left.select(F.col("k").alias("rk"), F.col("id").alias("r_numseq")), ["rk"]
        )
        for how in ("inner", "left"):
            joined = matching.lookup(left, right, {"k": "rk"}, how)
            total = joined.groupBy((F.col("id") % 3 == 0).alias("hot")).agg(
                F.count("r_numseq").alias("n"))
            assert {r.hot: r.n for r in total.collect()} == {True: 20000, False: 40000}
            assert "skew=true" in plan_of(total), plan_of(total)
    finally:
        for name in SKEW:
            spark.conf.unset(name)



def test_a_bucketed_table_is_joined_where_it_lies(spark, derived):
    from concilia.functions.prepare import prepare_registry
    from concilia.sources import sinks

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.save_bucketed(derived.registry, "registry_in_place", "codcco", 8)
        newest = matching.newest_rows(prepare_registry(spark.table("registry_in_place")), ["r_codcco"])
        want = matching.lookup(derived.m, matching.newest_rows(derived.r, ["r_codcco"]), {"codcco": "r_codcco"}, "left")
        # A third of the members on one CCO, and some without any.
        hot = derived.m.withColumn("codcco", F.when(F.col("id") % 3 == 0, F.lit("000000000008")).when(F.col("id") % 7 > 0, F.col("codcco")))
        for members, kept in ((derived.m, want), (hot, None)):
            got = matching.lookup_on_layout(members, newest, "codcco", "r_codcco", "left")
            plan = plan_of(got)
            moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert moved and not any("r_codcco" in line for line in moved), plan
            assert got.count() == members.count()
            if kept is None:
                kept = matching.lookup(members, matching.newest_rows(derived.r, ["r_codcco"]), {"codcco": "r_codcco"}, "left")
                assert "BroadcastHashJoin" in plan
            columns = ["id", "r_numseq", "r_status"]
            assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, kept.select(*columns).collect()))
            inner = matching.lookup_on_layout(members, newest, "codcco", "r_codcco", "inner")
            assert inner.count() == got.where("r_codcco is not null").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_a_task_sorts_does_not_follow_from_the_number_of_partitions(spark):
    """With few shuffle partitions set, a large exchange is still dealt into more tasks."""
    adapt(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rows = spark.range(0, 400_000, 1, 4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        assert matching.distinct_keys(rows, "text").rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_files_of_derived_tables_are_bounded(spark, folder, monkeypatch):
    from concilia.sources import derived as source

    monkeypatch.setattr(source, "ROWS_PER_FILE", 40)
    names = {"customer": "select id as c_custkey from range(150)",
             "orders": "select id as o_orderkey, id % 150 as o_custkey, 'O' as o_orderstatus from range(300)"}
    for name, sql in names.items():
        spark.sql(sql).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    ctx = source.load(spark, folder)
    for table, least in ((ctx.members, 150), (ctx.registry, 280)):
        sizes = [r["count"] for r in table.groupBy(F.input_file_name().alias("f")).count().collect()]
        assert sum(sizes) >= least and max(sizes) <= 40


def test_a_side_is_broadcast_by_its_rows_not_by_its_files(spark, folder):
    """Some 30 MB of keys lie in files of a few KB; a side of ten rows is broadcast all the same."""
    adapt(spark)
    key = lambda n: F.concat(F.repeat(F.lit("k"), 100), (F.col("id") % n).cast("string"))
    spark.range(0, 200_000, 1, 2).select(key(200_000).alias("rk")).write.parquet(f"{folder}/large")
    spark.range(10).select(key(10).alias("rk")).write.parquet(f"{folder}/small")
    left = spark.range(1000).select("id", key(400_000).alias("k"))
    for side, n in (("large", 1000), ("small", 10)):
        right = matching.distinct_keys(spark.read.parquet(f"{folder}/{side}"), "rk")
        found = matching.lookup(left, right, {"k": "rk"}, "left_semi")
        assert len(found.collect()) == n
        assert ("BroadcastHashJoin" in plan_of(found).split("Initial Plan")[0]) == (side == "small")
