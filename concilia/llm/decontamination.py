"""Benchmark decontamination: test items in texts, up to a budget of edits.

An item with at most e edits keeps one of its e + 1 pieces whole (pigeonhole), so the
pieces are looked up exactly by an Aho-Corasick automaton, and what surrounds a hit is
verified by Myers' bit-parallel edit distance. Documents are never shuffled; the benchmark
is the stated query set and goes to the tasks in bounded blocks, as files of the shared
folder that each task opens: the driver sees their number. A block is a pass over the
texts, joined to the others in one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concilia.session import shared_folder

from .common import staged, text_or_empty

#: So many blocks are searched in one stage; each has an automaton of its own in every task.
_STAGE = 4


def normal(text: str) -> str:
    """Lower case, with single spaces."""
    return " ".join(text.lower().split())


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` adjoining ranges that cover an item, as equal as can be."""
    cuts = [length * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


def distance(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text``, and where that ends (Myers)."""
    full = (1 << len(item)) - 1
    top = 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best, at = score, 0
    for position, char in enumerate(text, 1):
        equal = masks.get(char, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | ~(across | up) & full
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, at = score, position
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
    return best, at


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a range begins and ends where words do."""
    inside = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not inside(start) and not inside(end)


class Matcher:
    """The pieces of some items, and their verification."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, normal(t), int(len(normal(t)) * error_rate)) for i, t in items]
        self.automaton, starts = ahocorasick.Automaton(), {}
        for number, (_, text, budget) in enumerate(self.items):
            for a, b in pieces(len(text), min(budget, max(0, len(text) - 1))):
                if b > a:
                    starts.setdefault(text[a:b], []).append((number, a, b))
        for piece, places in starts.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, number: int) -> dict[str, int]:
        if number not in self.masks:
            masks: dict[str, int] = {}
            for i, char in enumerate(self.items[number][1]):
                masks[char] = masks.get(char, 0) | 1 << i
            self.masks[number] = masks
        return self.masks[number]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, edits)`` in the normalised text: an item's best match in each
        stretch of hits, with the stretch where it may start."""
        if not len(self.automaton):
            return []
        text, starts = normal(text), {}
        for end, places in self.automaton.iter(text):
            for number, a, b in places:
                starts.setdefault(number, set()).add(end + 1 - b)
        found = []
        for number, diagonals in starts.items():
            item_id, item, budget = self.items[number]
            low = high = None
            for start in [*sorted(diagonals), None]:
                if low is not None and (start is None or start > high + 2 * budget + 1):
                    found += self._verified(number, text, max(0, low - budget), high + len(item) + budget)
                    low = None
                if start is not None:
                    low, high = (start if low is None else low), start
        return sorted(found)

    def _verified(self, number: int, text: str, start: int, end: int) -> list[tuple[int, int, int, int]]:
        item_id, item, budget = self.items[number]
        exact = text.find(item, start, end)
        if not budget:
            # Too short to bear an edit: only whole words tell.
            while exact >= 0 and not _whole(text, exact, exact + len(item)):
                exact = text.find(item, exact + 1, end)
        if exact >= 0:
            return [(item_id, exact, exact + len(item), 0)]
        if not budget:
            return []
        edits, at = distance(item, self._masks(number), text[start:end])
        return [(item_id, max(0, start + at - len(item)), start + at, edits)] if edits <= budget else []


def item_blocks(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str, min_chars: int) -> list[str]:
    """Folders of the items in blocks of about ``block_chars`` characters, written to the shared
    folder; the driver only learns how many there are."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = items.where(F.length("text") >= min_chars).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    folder = f"{shared_folder(benchmark.sparkSession)}/items-{uuid.uuid4().hex}"
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")
    items.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
    return [f"{folder}/block={i}" for i in range(n)]


def _items(path: str) -> list[tuple[int, str]]:
    """The items of a block; an empty one has no folder."""
    system, name = fs.FileSystem.from_uri(path)
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return []
    files = [f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=system, columns=["id", "text"], partitioning=None) for f in files]
    return sorted((row for t in tables for row in zip(*(c.to_pylist() for c in t.columns))), key=_order)


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    error_rate: float = 0.05,
    block_chars: int = 4_000_000,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_chars: int = 1,
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``matches``: an array of structs
    ``item_id, start, end, edits`` sorted by item.

    Case and white space do not count. An item of n characters may have
    ``n * error_rate`` edits (rounded down). Positions are those of the normalised text;
    the start of a match with edits is that of its end less the item's length. An item too
    short for an edit must begin and end where words do; items of fewer than ``min_chars``
    characters are left out (none by default). Null or
    blank items and texts match nothing; each row is searched by itself, so repeated rows
    agree, and repeated items report each id once. Columns may have any name. A benchmark of
    any size is worked through in blocks. An empty table yields an empty result.
    """
    span = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "end", "edits")]))
    found = docs.select(F.struct("*").alias("row")).withColumn("matches", F.array().cast(T.ArrayType(span)))

    def searcher(path: str):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(_items(path), error_rate)
            for batch in batches:
                matches = []
                for text, before in zip(batch.column("text"), batch.column("matches")):
                    own = {tuple(m.values()) for m in before.as_py()} | set(matcher.find(text.as_py()))
                    matches.append([dict(zip(("item_id", "start", "end", "edits"), m)) for m in sorted(own, key=_order)])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(matches, kind)], ["row", "matches"])

        return each

    schema = found.schema
    for number, path in enumerate(item_blocks(benchmark, block_chars, item_id_col, item_text_col, min_chars), 1):
        rows = found.select("row", "matches", text_or_empty(F.col("row").getField(text_col)).alias("text"))
        found = rows.mapInArrow(searcher(path), schema)
        if number % _STAGE == 0:
            found = staged(found, "searched")
    return found


def _order(match: tuple) -> tuple:
    return tuple((value is not None, value or 0) for value in match)
