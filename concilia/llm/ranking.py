"""Ranked lexical search by presence masks.

Every item asks for the best documents among all. The documents of a batch are sets of bits,
one set per term; for an item they are turned into one mask per document: which of its
terms the document holds. Documents with one mask are a group, and the sum of their terms'
highest possible contributions bounds every score in it. Groups are scored in descending
order of that bound, until the bound is no longer above the worst of the ``top`` scores
found so far by the task.

Items are worked through in blocks of bounded size. A block reads all texts once, keeps the
occurrences of its own terms per document, sums what all documents must know together
(their number, length and each term's document frequency), and ranks from what it kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, staged, text_or_empty

#: So many pairs of term and document are laid out at once.
_CELLS = 4_000_000

#: Terms: runs of ASCII letters and digits and of characters beyond ASCII; A-Z become small.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


class Block:
    """Some items: the vocabulary of their terms, and each item's terms by number."""

    def __init__(self, items: list[tuple[int, str | None]]):
        wanted = [list(dict.fromkeys(terms(text))) for _, text in items]
        self.numbers = {t: i for i, t in enumerate(dict.fromkeys(t for own in wanted for t in own))}
        self.items = [(item, np.array([self.numbers[t] for t in own])) for (item, _), own in zip(items, wanted) if own]


def _occurrences(rows: DataFrame, numbers) -> DataFrame:
    """``id, n, terms, counts``: each document's length, and how often it holds the block's terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            lengths, sizes, found, often = [], [0], [], []
            for text in batch.column("text"):
                own = terms(text.as_py())
                held = Counter(n for n in map(known.get, own) if n is not None)
                lengths.append(len(own))
                found += held.keys()
                often += held.values()
                sizes.append(len(found))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType().add(rows.schema["id"]).add("n", "long").add("terms", ints).add("counts", ints)
    return rows.mapInArrow(each, schema)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """``floor(1000 ln((2 N + 2) / (2 df + 1)))`` of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_terms(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """``m`` of each document: ``100 - 50 + (50 n N) div L``."""
    if len(n) and int(n.max()) * n_docs * 50 < 2**63:
        return 50 + 50 * n * n_docs // max(all_terms, 1)
    return np.array([50 + 50 * int(x) * n_docs // max(all_terms, 1) for x in n], np.int64)


def masks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks of ``bits`` (a packed row of bits per term, a bit per document), one
    row of booleans per mask, and the mask of each document."""
    held = np.unpackbits(bits, axis=1).T  # documents by terms
    packed = np.packbits(held, axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    words = wide.view(np.uint64)
    if words.shape[1] == 1:
        _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    else:
        order = np.lexsort(words.T)
        changes = np.concatenate([[True], (words[order[1:]] != words[order[:-1]]).any(1)])
        first, group = order[changes], np.empty(len(order), np.int64)
        group[order] = np.cumsum(changes) - 1
    return held[first].astype(bool), group


class Best:
    """The best documents of one item so far: scores and places, at most ``top``."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), []

    def worst(self) -> int:
        """A score must be above this, or equal it with a smaller id, to come in."""
        return int(self.scores[-1]) if len(self.scores) == self.top else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        scores = np.concatenate([self.scores, scores])
        ids = self.ids + ids
        order = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), ids[i] is None, ids[i]))[: self.top]
        self.scores, self.ids = scores[order], [ids[i] for i in order]


def rank_batch(best: Best, own: np.ndarray, bits: np.ndarray, gains: np.ndarray, most: np.ndarray, ids: list) -> int:
    """Ranks a batch for one item; gives how many documents were scored.

    ``bits`` are the sets of documents by term, ``gains`` the contributions by term and
    document, ``most`` the highest contribution of each term; ``own`` are the item's terms.
    """
    mine = np.bitwise_or.reduce(bits[own], axis=0)
    if not mine.any():
        return 0
    held, group = masks(bits[own])
    bound = held.astype(np.int64) @ most[own]
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=len(held))
    ends, upto = np.cumsum(sizes), np.cumsum(sizes[order])
    scored, at = 0, 0
    while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= best.worst():
        # Some groups at once: as many as make up the documents asked for, then twice as many.
        end = int(np.searchsorted(upto, max(best.top, 2 * scored))) + 1
        some = order[at : max(end, at + 1)]
        some = some[bound[some] >= max(best.worst(), 1)]
        docs = np.concatenate([members[(ends[g - 1] if g else 0) : ends[g]] for g in some.tolist()])
        docs = docs[docs < len(ids)]
        scores = gains[np.ix_(own, docs)].sum(0)
        keep = (scores > 0) & (scores >= best.worst())
        scored += len(docs)
        if keep.any():
            # Only the first ``top`` of a step can stay, ties at the last score included.
            docs, scores = docs[keep], scores[keep]
            if len(docs) > best.top:
                last = -np.partition(-scores, best.top - 1)[best.top - 1]
                docs, scores = docs[scores >= last], scores[scores >= last]
            best.add(scores, [ids[i] for i in docs.tolist()])
        at = max(end, at + 1)
    return scored


def _ranked(held: DataFrame, items, weight, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """``item, id, score``: each task's ``top`` documents per item of the (broadcast) block."""
    id_type = to_arrow_type(held.schema["id"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wanted = weight.value, items.value
        best, some = [Best(top) for _ in wanted], max(_CELLS // len(w), 16)
        for whole in batches:
            for at in range(0, len(whole), some):
                batch = whole.slice(at, some)
                lists, often = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
                docs = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
                term, m = lists.flatten().to_numpy(), length_terms(batch.column("n").to_numpy(), n_docs, all_terms)
                gains, here = np.zeros((len(w), len(batch)), np.int64), np.zeros((len(w), len(batch)), bool)
                gains[term, docs] = w[term] * (1_000_000_000 * often // (1000 * often + 20 * m[docs]))
                here[term, docs] = True
                bits, most, ids = np.packbits(here, axis=1), gains.max(1, initial=0), batch.column("id").to_pylist()
                for state, (_, own) in zip(best, wanted):
                    rank_batch(state, own, bits, gains, most, ids)
        number = [i for i, b in enumerate(best) for _ in b.ids]
        scores = [s for b in best for s in b.scores.tolist()]
        ids = pa.array([x for b in best for x in b.ids], id_type)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), ids, pa.array(scores, pa.int64())], ["item", "id", "score"])

    return held.mapInArrow(each, T.StructType().add("item", "integer").add(held.schema["id"]).add("score", "long"))


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    """The items in blocks of up to ``most`` terms (repeats included), one item at least. One
    block at a time is in the driver."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        length = len(terms(row.text))
        if block and size + length > most:
            yield Block(block)
            block, size = [], 0
        block.append((row.item, row.text))
        size += length
    if block:
        yield Block(block)


def _top(found: DataFrame, group: list[Column], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 50,
    block_terms: int = 20_000,
) -> DataFrame:
    """``item, rank, id, score``: each item's ``top`` documents with a score above 0.

    A term's weight falls with the number of documents that hold it; a document's score sums
    ``w * ((10^9 tf) div (1000 tf + 20 m))`` over the item's terms, once each, where ``m``
    grows with the document's length. Equal scores rank by id, null ids last. A null text has
    no terms; an item without known terms has no rows. Every row of ``docs`` is a document
    and every row of ``items`` an item, repeated rows and ids included. Columns may have any
    name; others are not read. Empty tables yield an empty result.

    Each block of ``block_terms`` terms reads the texts once. A task gives ``top`` rows per
    item, so what meets at an item is cut in two steps: among some tasks, then among all.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    item_type = items.schema[item_col].dataType
    shape = T.StructType().add("item", item_type).add("rank", "integer").add("id", rows.schema["id"].dataType).add("score", "long")
    out = spark.createDataFrame([], shape)
    for block in _blocks(items, item_col, item_text_col, block_terms):
        if not block.items:
            continue
        numbers = context.broadcast(block.numbers)
        held = staged(_occurrences(rows, numbers), "occurrences")
        n_docs, all_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.numbers), np.int64)
        for term, count in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = count
        wanted, weight = context.broadcast(block.items), context.broadcast(weights(df, n_docs))
        found = _ranked(held.where(F.size("terms") > 0), wanted, weight, n_docs, all_terms, top)
        found = found.withColumn("share", F.spark_partition_id() % partitions(spark))
        found = _top(_top(found, [F.col("item"), F.col("share")], top), [F.col("item")], top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block.items)], T.StructType().add("item", "integer").add("of", item_type))
        found = found.join(F.broadcast(names), "item").select(F.col("of").alias("item"), "rank", "id", "score")
        out = out.unionByName(staged(found, "ranked"))
        for sent in (numbers, wanted, weight):
            sent.destroy()
    return out


def sql(table: str, items: str, top: int = 50) -> str:
    """The same for a second engine."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{TERMS}')) term"
    return rf"""
with t as (select doc_id, {cut} from {table}),
q as (select distinct item_id, term from (select item_id, {cut} from {items})),
n as (select doc_id, count(*) n from t group by 1),
s as (select count(*) docs, sum(n)::bigint terms from n),
f as (select doc_id, term, count(*) tf from t where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint w from f, s group by term, docs),
p as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::bigint score
    from q join f using (term) join w using (term) join n using (doc_id), s group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from p where score > 0)
select item_id, rank, doc_id, score from r where rank <= {top}"""
