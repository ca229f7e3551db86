"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. The distinct blocks are sorted and get integers as
names; then adjacent names are paired, the distinct pairs are sorted and named, and so on,
until every text has one name. Texts with one name are equal, byte for byte: no name rests
on a hash alone. Only built-in expressions are used.

The contents of all blocks are shuffled once, under a hash that finds equal blocks. Where
different blocks share a hash, all of them are named by their contents instead. From then on
only integers move: a 1024th part of the corpus, halved by every round of pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, text_or_empty

#: Runs of ASCII white space; each compares as one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), WHITE, " ")


def _blocks(data: Column, size: int, each) -> Column:
    """``each(block)`` for the blocks of ``data``, in order; empty data is one empty block.

    ``data`` becomes the element of an array first, so that it is computed once a row.
    """
    def cut(whole: Column) -> Column:
        last = F.greatest(F.floor((F.length(whole) - 1) / size), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: each(F.substring(whole, i * size + 1, F.lit(size))))

    return F.flatten(F.transform(F.array(data.cast("binary")), cut))


def _mark(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits) if bits < 64 else F.xxhash64(block)


def _sorted_names(distinct: DataFrame, *by: str) -> DataFrame:
    """Adds ``name``: integers in the order of ``by``, from a range-partitioned sort."""
    ordered = distinct.repartitionByRange(partitions(distinct.sparkSession), *by).sortWithinPartitions(*by)
    return staged(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _first_names(docs: DataFrame, text_col: str, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Names of all blocks: ``mark, name`` where one block has the mark, and ``mark, block,
    name`` where several share it."""
    pair = lambda block: F.struct(_mark(block, bits).alias("mark"), block.alias("block"))
    cut = docs.select(F.explode(_blocks(normalised(text_col), size, pair)).alias("b")).select("b.mark", "b.block")
    # Only this first distinct moves contents; it tells how many different blocks a mark has.
    counts = staged(cut.distinct().groupBy("mark").count(), "counts")
    seen = counts.where("count = 1").select("mark", F.lit(None).cast("binary").alias("block"))
    several = counts.where("count > 1").select("mark")
    if not several.isEmpty():
        seen = seen.unionByName(cut.join(several, "mark", "left_semi").distinct())
    names = _sorted_names(seen, "mark", "block")
    return names.where("block is null").select("mark", "name"), names.where("block is not null")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024, mark_bits: int = 64) -> DataFrame:
    """``row, id, text_sha256, level, name``: one row per row of ``docs``. Rows have equal
    ``(level, name)`` if and only if their normalised texts are equal.

    ``row`` numbers the rows. ``block_bytes`` is the size of a block; ``mark_bits`` is how
    many bits of the hash lead to a block (fewer only make more blocks meet).
    """
    text = normalised(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("text_sha256"),
        _blocks(text, block_bytes, lambda block: _mark(block, mark_bits)).alias("marks"),
    )
    rows = staged(rows, "marks")
    alone, shared = _first_names(docs, text_col, block_bytes, mark_bits)
    places = rows.select("row", F.size("marks").alias("left"), F.posexplode("marks").alias("pos", "mark"))
    named = places.join(alone, "mark").select("row", "left", "pos", "name")
    if not shared.isEmpty():
        named = named.unionByName(_by_content(docs, rows, shared, id_col, text_col, block_bytes))
    named = staged(named, "named")
    level, done = 0, []
    while True:
        done.append(named.where(F.col("left") == 1).select("row", F.lit(level).alias("level"), "name"))
        open_rows = named.where(F.col("left") > 1)
        if open_rows.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = open_rows.groupBy("row", half.alias("pos")).agg(
            F.first(F.ceil(F.col("left") / 2).cast("int")).alias("left"),
            side(0).alias("a"),
            F.coalesce(side(1), F.lit(-1)).alias("b"),  # the last name of an odd number stays alone
        )
        pairs = staged(pairs, "pairs")
        names = _sorted_names(pairs.select("a", "b").distinct(), "a", "b")
        named = staged(pairs.join(names, ["a", "b"]).select("row", "left", "pos", "name"), "named")
        level += 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return rows.select("row", "id", "text_sha256").join(found, "row")


def _by_content(docs: DataFrame, rows: DataFrame, shared: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Names of blocks whose mark several blocks share, looked up by content.

    The texts are read again for these marks alone; a text finds its rows by its id and its
    SHA-256, so equal rows get the same names.
    """
    text = normalised(text_col)
    again = docs.select(F.col(id_col).alias("of"), F.sha2(text, 256).alias("sha"), _blocks(text, size, lambda b: b).alias("blocks"))
    again = again.dropDuplicates(["of", "sha"]).select("of", "sha", F.posexplode("blocks").alias("at", "block"))
    again = again.join(shared.select("block", "name"), "block").select("of", "sha", "at", "name")
    keyed = rows.select("row", F.size("marks").alias("left"), "id", "text_sha256")
    return keyed.join(again, F.expr("id <=> of and text_sha256 = sha")).select("row", "left", F.col("at").alias("pos"), "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024, mark_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space becomes one space; a
    null text is empty. Of equal texts the row with the smallest id stays (``kept``); a null
    id comes last, and of rows that repeat id and text one stays. ``group_size`` counts rows.
    A group that holds a third of all rows is a partial minimum and a lookup, never one
    task's group. An empty table yields an empty result; other columns are not read.
    """
    known = staged(identities(docs, id_col, text_col, block_bytes, mark_bits), "identities")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = known.groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    # Written, so that the lookup is a join of its own, which adaptive execution can split.
    groups = staged(groups.where("group_size > 1"), "groups")
    first = F.when(F.col("group_size") > 1, F.col("first"))
    return known.join(groups, ["level", "name"], "left").select(
        "id",
        F.when(first.isNull(), F.col("id")).otherwise(first["id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == first["row"], F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and
    text one stays, and rows with null ids stay only if no row with an id has their text."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("of"), F.col("text_sha256").alias("sha"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("text_sha256"))
    found = rows.join(kept, F.expr("id <=> of and text_sha256 = sha"), "left_semi")
    return found.dropDuplicates(["id", "text_sha256"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def sql(table: str) -> str:
    """The same for a second engine; ids must be unique and present."""
    return rf"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g') t from {table})
select doc_id, min(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
    doc_id = min(doc_id) over (partition by t) kept, sha256(t) text_sha256 from d"""
