"""Substring dedup by suffix order: bytes that an earlier 100-byte string covers are removed.

In suffix order, the suffix before one and the suffix after one that start at smaller
positions give its longest previous factor (LPF); a window of ``width`` bytes occurs
earlier exactly if the LPF of its start is at least ``width``. A suffix array of all bytes
of a corpus is neither needed nor affordable, so windows are first put where their equals
must be:

1. Each window names an *anchor*, the least hash among its k-grams. Equal windows name
   equal anchors; neighbouring windows mostly share one, and form a segment.
2. Segments meet at their anchor. Equal segments hold equal windows: all but the earliest
   are removed whole. What is left is one segment of each content; where an anchor has
   just one content, its windows occur nowhere else.
3. The windows of an anchor's different segments are put in suffix order, and their LPF
   decides. Of an anchor with very many contents, shares are put in order apart; the
   windows that are first in their share then meet by content.

Copies inside a task are combined before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, staged, text_or_empty

GRAM = 32  #: bytes of a k-gram
_BLOCK = 1 << 18  #: windows whose anchors are found at a time
_SMALLEST = -(1 << 63)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _words(data: bytes) -> np.ndarray:
    """The big-endian 8-byte word at every position but the last seven."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for shift in range(min(8, len(out))):
        part = np.frombuffer(data, ">u8", (len(data) - shift) // 8, shift)
        out[shift::8] = part
    return out


def _gram_hashes(data: bytes) -> np.ndarray:
    words = _words(data)
    n = len(data) - GRAM + 1
    mixed = words[:n] * _FACTORS[0]
    for i in (1, 2, 3):
        mixed ^= mixed >> np.uint64(31)
        mixed = (mixed + words[8 * i : 8 * i + n]) * _FACTORS[i]
    return mixed ^ mixed >> np.uint64(29)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys, from minima up to and from block borders."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[:n], upto[width - 1 : width - 1 + n])


def segments(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each segment of a text, in order."""
    parts = []
    hashes = _gram_hashes(data) if len(data) >= width else np.zeros(0, np.uint64)
    span = width - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(data) - width + 1), _BLOCK):
        own = hashes[at : at + _BLOCK + span - 1]
        # The last of equal hashes wins, so that the choice depends on content alone.
        keys = own & ~low | low - np.arange(len(own), dtype=np.uint64)
        place = (low - (_least(keys, span) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        parts.append((own[place[first]], first + at, last + at))
    if not parts:
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


_SEGMENT = ["anchor", "content", "id", "hash", "first", "last", "removed"]


def _segment_batch(rows: list[tuple[int, int, str]], width: int) -> pa.RecordBatch:
    """The segments of some texts; those that occur earlier among them are marked removed."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    digest = xxhash.xxh64_digest
    for id_, hash_, text in sorted(set(rows)):  # by position, repeated rows once
        data = text.encode()
        anchor, first, last = segments(data, width)
        content = b"".join([digest(data[a:b]) for a, b in zip(first.tolist(), (last + width).tolist())])
        values = (anchor.view(np.int64), np.frombuffer(content, ">i8"), np.full(len(first), id_), np.full(len(first), hash_), first, last)
        for column, value in zip(columns, values):
            column.append(value)
    anchor, content, *place = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
    order = np.lexsort((content, anchor))  # stable: equal segments stay in order of position
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[order[1:]] == anchor[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    removed = np.zeros(len(order), bool)
    removed[order] = same
    # Removed ones are only passed on; a scattered key keeps copies from piling up.
    scattered = ((place[0] + place[2]).astype(np.uint64) * _FACTORS[0]).view(np.int64)
    anchor = np.where(removed, scattered, anchor)
    arrays = [pa.array(anchor), pa.array(np.ascontiguousarray(content, np.int64)), pa.array(place[0].astype(np.int64))]
    arrays.append(pa.array(place[1]))
    arrays += [pa.array(p.astype(np.int32)) for p in place[2:]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(removed)], _SEGMENT)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """From segments in order of anchor, content and position: those to be removed
    (kind 0) and the first of each content of an anchor that has several (kind 1).

    Between batches only two rows are kept: the first of the current anchor and the first
    of its current content.
    """
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(_SEGMENT, batch.columns)}
        rows["told"] = np.zeros(len(rows["anchor"]), bool)
        ready = rows.pop("removed")
        passed = {n: c[ready] for n, c in rows.items()}
        yield np.zeros(len(passed["anchor"]), np.int32), passed
        rows = {n: c[~ready] for n, c in rows.items()}
        if held is not None:
            rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
        n = len(rows["anchor"])
        if not n:
            continue
        new_anchor = np.append(True, rows["anchor"][1:] != rows["anchor"][:-1])
        new_content = new_anchor | np.append(True, rows["content"][1:] != rows["content"][:-1])
        heads = np.flatnonzero(new_content)
        origin = heads[np.cumsum(new_content) - 1]
        moved = np.zeros(n, bool)
        for name in ("id", "hash", "first"):  # the same row read twice is no copy of itself
            moved |= rows[name] != rows[name][origin]
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group[heads])[group] > 1
        later = ~new_content & moved & ~rows["told"]
        split = new_content & several & ~rows["told"]
        rows["told"] |= split
        for kind, chosen in ((0, later), (1, split)):
            yield np.full(int(chosen.sum()), kind, np.int32), {name: c[chosen] for name, c in rows.items()}
        last = np.unique([np.flatnonzero(new_anchor)[-1], heads[-1]])
        held = {name: c[last] for name, c in rows.items()}


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF of each position from the suffix order and the common prefixes of neighbours.

    ``order[i]`` is the position of the i-th suffix, ``lcp[i]`` what it shares with the one
    before. Before and after each suffix the nearest one that starts earlier is looked for;
    the longer of the two common prefixes is the LPF.
    """
    n = len(order)
    found = np.zeros(n, np.int64)
    after = np.append(lcp[1:], 0)[::-1] if n else lcp
    for positions, shared, back in ((order, lcp, False), (order[::-1], after, True)):
        near, common = np.arange(n) - 1, shared.astype(np.int64)
        while True:  # all search at once: one that fails goes on where its neighbour's search is
            open_ = np.flatnonzero((near >= 0) & (positions[near] > positions))
            if not len(open_):
                break
            by = near[open_]
            common[open_] = np.minimum(common[open_], common[by])
            near[open_] = near[by]
        own = np.where(near >= 0, common, 0)
        found = np.maximum(found, own[::-1] if back else own)
    factors = np.zeros(n, np.int64)
    factors[order] = found
    return factors


def _prefix_order(
    words: np.ndarray, starts: np.ndarray, numbers: np.ndarray, width: int, salt: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that start at ``starts``, in groups ``numbers``: which of them have equals in
    their group, and the rank of each of these by group and the window's bytes.

    Equals meet by a hash; one of each kind is ranked by its bytes, and all are compared
    with it byte for byte; if hashes ever collide, another salt is taken.
    """
    places = [*range(0, width - 7, 8), width - 8]
    mixed = (numbers.astype(np.uint64) + np.uint64(salt)) * _FACTORS[1]
    for place in places:
        mixed = (mixed ^ words[starts + place]) * _FACTORS[0]
        mixed ^= mixed >> np.uint64(29)
    by_hash = np.argsort(mixed)
    sorted_ = mixed[by_hash]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1])
    often = ~fresh | ~np.append(fresh[1:], True)
    chosen, kinds = by_hash[often], np.cumsum(fresh[often]) - 1
    one = chosen[fresh[often]]
    columns = [words[starts[one] + place] for place in places]
    if any((words[starts[chosen] + place] != column[kinds]).any() for place, column in zip(places, columns)):
        return _prefix_order(words, starts, numbers, width, salt + 1000003)
    ranks = np.empty(len(one), np.int64)
    ranks[np.lexsort([*reversed(columns), numbers[one]])] = np.arange(len(one))
    by_place = np.argsort(chosen)
    return chosen[by_place], ranks[kinds[by_place]]


def _repeated(groups: list[list[tuple]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of segments ``(text, first, last, ...)`` in order of position, by
    group: the number of the segment and the offset of each that occurs earlier in its
    group."""
    text = b"".join(s[0] for g in groups for s in g)
    lengths = np.array([len(s[0]) for g in groups for s in g])
    numbers = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    counts = lengths - width + 1
    segment = np.repeat(np.arange(len(lengths)), counts)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(lengths) - lengths)[segment] + offset
    # Windows without an equal share less than their width with their neighbours.
    chosen, ranks = _prefix_order(_words(text), starts, numbers[segment], width)
    order = np.argsort(ranks, kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(ranks[order[1:]] == ranks[order[:-1]], width, 0)
    found = chosen[previous_factors(order, lcp) >= width]
    return segment[found], offset[found]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist()))


def removed_windows(docs: DataFrame, width: int, id_col: str, text_col: str, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, windows)``: the texts as ``doc_id, id, hash, text``, and per text ``id, hash,
    ranges`` with the first and last start of windows that occur earlier."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_SMALLEST)).alias("id"), F.xxhash64(text_col).alias("hash"), text_or_empty(text_col).alias("text")
    )
    number = partitions(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _segment_batch(list(zip(*(c.to_pylist() for c in batch.columns))), width)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, found in _met(batches):
            names = ["anchor", "id", "hash", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(found[n]) for n in names)], ["kind", *names])

    cuts = rows.mapInArrow(cut, "anchor long, content long, id long, hash long, first int, last int, removed boolean")
    cuts = cuts.repartition(number, "anchor").sortWithinPartitions("anchor", "content", "id", "hash", "first")
    met = staged(cuts.mapInArrow(meet, "kind int, anchor long, id long, hash long, first int, last int"), "segments")

    split = met.where("kind = 1")
    hot = split.groupBy("anchor").count().where(F.col("count") > group_limit)
    hot = staged(hot.select("anchor", F.ceil(F.col("count") / group_limit).cast("int").alias("shares")), "anchors")
    split = split.join(hot, "anchor", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    share = F.pmod(F.xxhash64("id", "hash", "first"), F.col("shares")).cast("int")
    wanted = split.groupBy("id", "hash").agg(F.collect_list(F.struct("anchor", share.alias("share"), "shares", "first", "last")).alias("segments"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "share", "shares", "first", "last"]
        for batch in batches:
            for at in range(len(batch)):
                data = batch.column("text")[at].as_py().encode()
                found = batch.column("segments")[at].values
                first, last = found.field("first").to_pylist(), found.field("last").to_pylist()
                texts = pa.array([data[a : b + width] for a, b in zip(first, last)], pa.binary())
                owner = [pa.array([batch.column(c)[at].as_py()] * len(first), k) for c, k in (("id", pa.int64()), ("hash", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*owner, *(found.field(n) for n in names), texts], ["id", "hash", *names, "text"])

    texts = rows.join(wanted, ["id", "hash"]).select("id", "hash", "text", "segments").mapInArrow(
        fetch, "id long, hash long, anchor long, share int, shares int, first int, last int, text binary"
    )
    texts = texts.repartition(number, "anchor", "share").sortWithinPartitions("anchor", "share", "id", "hash", "first")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = [], 0
        for batch in batches:
            for id_, hash_, anchor, share, shares, first, last, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not groups or groups[-1][0][3:5] != (anchor, share):
                    if size >= 20_000:
                        yield ranked(groups)
                        groups, size = [], 0
                    groups.append([])
                if groups[-1] and groups[-1][-1][6:] == (id_, hash_) and groups[-1][-1][1] == first:
                    continue  # a repeated row
                groups[-1].append((text, first, last, anchor, share, shares, id_, hash_))
                size += 1
        if groups:
            yield ranked(groups)

    def ranked(groups: list[list[tuple]]) -> pa.RecordBatch:
        """Ranges that occur earlier (no ``mark``), and of shared groups, the other windows."""
        segment, offset = _repeated(groups, width)
        flat = [s for g in groups for s in g]
        out = []
        cuts = np.searchsorted(segment, np.arange(len(flat) + 1))
        by_segment = np.lexsort((offset, segment))
        segment, offset = segment[by_segment], offset[by_segment]
        cuts = np.searchsorted(segment, np.arange(len(flat) + 1))
        for i, (text, first, last, _, _, shares, id_, hash_) in enumerate(flat):
            own = offset[cuts[i] : cuts[i + 1]]
            if len(own):
                out += [(id_, hash_, a + first, b + first, None) for a, b in _ranges(own)]
            if shares > 1:
                for start in np.setdiff1d(np.arange(last - first + 1), own).tolist():
                    out.append((id_, hash_, start + first, start + first, xxhash.xxh3_128_digest(text[start : start + width])))
        columns = zip(*out) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "hash", "first", "last", "mark"])

    ordered = staged(texts.mapInArrow(order, "id long, hash long, first int, last int, mark binary"), "windows")
    shared = ordered.where("mark is not null")
    place = F.struct("id", "hash", "first")
    earliest = shared.groupBy("mark").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where(F.col("n") > 1)
    again = shared.join(earliest, "mark").where(place > F.col("origin"))
    columns = ("id", "hash", "first", "last")
    found = met.where("kind = 0").select(*columns).unionByName(ordered.where("mark is null").select(*columns)).unionByName(again.select(*columns))
    return rows, found.groupBy("id", "hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def without(data: bytes, ranges: list[tuple[int, int]], width: int) -> tuple[bytes, int, int]:
    """The bytes outside the windows that start in ``ranges``; removed bytes and maximal runs."""
    pieces, at, removed, spans = [], 0, 0, 0
    for first, last in sorted(ranges):
        if first > at or not spans:
            pieces.append(data[at:first])
            spans += 1
            removed += last + width - first
        else:
            removed += max(0, last + width - at)
        at = max(at, last + width)
    return b"".join(pieces) + data[at:], removed, spans


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, group_limit: int = 4096
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``docs``.

    Each byte that lies in a ``width``-byte string which also starts earlier is removed:
    in a smaller id, or in the same text at an earlier start. Strings are judged on the
    input. A null text is empty. Ids are whole numbers (``long``, or text that is one; other
    text fails the job). Rows that share an id are told apart and ordered by a 64-bit hash
    of the text; rows that repeat id and text are one and get equal results; null ids are
    one smallest id. Whole texts are read, whatever their length. Other columns are not
    read. An empty table yields an empty result.
    """
    if width < 64:
        raise ValueError("width must be at least 64")
    rows, windows = removed_windows(docs, width, id_col, text_col, group_limit)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, ranges in zip(batch.column("id"), batch.column("text"), batch.column("ranges")):
                data = text.as_py().encode()
                kept, removed, spans = without(data, [(r["first"], r["last"]) for r in ranges.as_py() or ()], width)
                id_ = id_.as_py()
                out.append((None if id_ == _SMALLEST else id_, len(data), removed, spans, kept))
            columns = zip(*out) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    joined = rows.join(windows, ["id", "hash"], "left").select("id", "hash", "text", "ranges")
    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
