"""SimHash near-duplicates, found through the codewords of a covering code.

Every fingerprint lies within the covering radius R of some codeword (an *anchor*). Two
fingerprints that differ in at most d bits therefore meet at the anchor next to the first
one if the second is copied to every anchor within R + d of itself. The code here is a
product of perfect binary Golay codes [23, 12] (R = 3), each on 23 bits of the fingerprint;
per block only the anchors that some change of at most d bits can reach get a copy, which
is the part of the R + d ball that a product code needs. No pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, staged, text_or_empty
from .components import components

BLOCK = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's polynomial
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles (repeats count); zero for a text without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends)])
    by_byte = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(by_byte)).tobytes(), "big", signed=True)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42
) -> DataFrame:
    """``doc_id, fingerprint`` (signed 64 bits) of every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t.as_py().encode(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fingerprint long")


class Golay:
    """Syndromes and, per syndrome, the codewords near a word as differences to the word."""

    def __init__(self, max_bits: int):
        words = np.arange(256)
        self.tables = [np.array([self._remainder(int(w) << shift) for w in words]) for shift in (0, 8, 16)]
        singles = [1 << i for i in range(BLOCK)]
        flips = [[0]]
        for _ in range(max(3, max_bits)):
            flips.append(sorted({e ^ s for e in flips[-1] for s in singles if not e & s}))
        correctable = np.array([e for level in flips[:4] for e in level])
        leaders = np.zeros(2048, np.int64)  # perfect code: one error of at most 3 bits each
        leaders[self.syndrome(correctable)] = correctable
        #: near[k][s]: differences from a word with syndrome s to the codewords that it is
        #: decoded to after k flipped bits, and after no fewer.
        self.near: list[list[np.ndarray]] = []
        seen = [np.zeros(0, np.int64)] * 2048
        for level in flips[: max_bits + 1]:
            masks = np.array(level)
            own = self.syndrome(masks)
            rows = [np.setdiff1d(masks ^ leaders[own ^ s], seen[s]) for s in range(2048)]
            seen = [np.concatenate(pair) for pair in zip(seen, rows)]
            self.near.append(rows)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        low, mid, high = self.tables
        return low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(BLOCK, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word


def anchors(marks: DataFrame, max_bits: int, blocks: int = 2, home: bool = False) -> DataFrame:
    """``anchor, mark`` for each distinct ``mark``: its nearest anchor (``home``), or every
    anchor that can be the home of a fingerprint within ``max_bits`` of it."""

    code = Golay(0 if home else max_bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(marks), 4096):
                yield _anchor_rows(code, marks[at : at + 4096], blocks)

    return marks.repartition(partitions(marks.sparkSession)).mapInArrow(each, "anchor long, mark long")


def _anchor_rows(code: Golay, marks: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Combines the blocks' near codewords whose numbers of flipped bits add up to the limit."""
    limit = len(code.near) - 1
    rows, keys = np.arange(len(marks)), np.zeros(len(marks), np.int64)
    spent = np.zeros(len(marks), np.int64)
    for block in range(blocks):
        words = marks >> (BLOCK * block) & ((1 << BLOCK) - 1)
        syndromes = code.syndrome(words)
        parts = []
        for k in range(limit + 1):
            able = np.flatnonzero(spent + k <= limit)
            masks = [code.near[k][s] for s in syndromes[rows[able]]]
            counts = np.array([len(m) for m in masks], np.int64)
            source = np.repeat(able, counts)
            codeword = words[rows[source]] ^ (np.concatenate(masks) if masks else np.zeros(0, np.int64))
            parts.append((rows[source], keys[source] << 12 | codeword >> 11, spent[source] + k))
        rows, keys, spent = (np.concatenate(p) for p in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(marks[rows])], ["anchor", "mark"])


def links(marks: DataFrame, max_bits: int, blocks: int = 2) -> DataFrame:
    """``a, b``: pairs of distinct marks (a < b) that differ in at most ``max_bits`` bits."""
    homes = anchors(marks, max_bits, blocks, home=True).select("anchor", F.col("mark").alias("a"))
    copies = anchors(marks, max_bits, blocks).select("anchor", F.col("mark").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return copies.join(homes, "anchor").where(F.col("a") < F.col("b")).where(close).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    seed: int = 42,
    blocks: int = 2,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` (longs) for every row of ``docs``.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id``
    is the smallest doc_id that links lead to. Equal fingerprints are one node, so copies
    are never paired. Only nodes and links travel, and a node goes to about 60 anchors
    whatever the size of its group; more ``blocks`` (at most 2 of 23 bits fit in 64) make
    anchors finer. Null or blank texts have fingerprint zero and are linked like any
    other; repeated rows yield repeated results; a null doc_id is never a component id
    unless the whole component has none. An empty table yields an empty result.
    """
    own = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = staged(own.groupBy(F.col("fingerprint").alias("mark")).agg(F.min("doc_id").alias("first")), "marks")
    found = components(links(nodes.select("mark"), max_bits, blocks), "a", "b")
    joined = nodes.join(found.withColumnRenamed("node", "mark"), "mark", "left")
    joined = joined.withColumn("root", F.coalesce("root", "mark"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = joined.join(smallest, "root", "left").select(
        F.col("mark").alias("fingerprint"), "component_id"
    )
    return own.join(labels, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")
