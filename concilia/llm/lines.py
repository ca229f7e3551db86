"""Line dedup by winnowing: repeated runs of lines lose all but their first occurrence.

A window is a shortest run of lines with ``min_words`` words, from a line on or up to a
line. Each window guarantees one fingerprint, its smallest line hash: equal windows choose
the same line. Only the chosen lines' hashes are joined at first; most occur once and are
done with. Where a chosen line meets its like, the match is extended both ways: the windows
from lines before it on and up to lines after it are compared by their whole content. Any
line of a repeated run lies in the window from it on or, if that leaves the run, in the one
up to the run's last line. So every line of every run of at least ``min_words`` words that
occurs earlier is found, and nothing shorter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, staged, text_or_empty


def _lines(text: str) -> tuple[list[bytes], list[int]]:
    """Lines of a text without white space at their ends, and where those with words are."""
    lines = [line.strip() for line in text.encode().split(b"\n")]
    return lines, [i for i, line in enumerate(lines) if line]


def marked(text: str) -> tuple[bytes, list[int]]:
    """The hashes of a text's lines with words, 16 bytes each, and how many words they have."""
    lines, places = _lines(text)
    return b"".join(xxhash.xxh3_128_digest(lines[i]) for i in places), [len(lines[i].split()) for i in places]


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """First and last line of each window: from every line on, and up to every line."""
    upto = [0, *accumulate(words)]
    ends = [bisect_left(upto, before + min_words) for before in upto[:-1]]
    onward = [(i, end - 1) for i, end in enumerate(ends) if end < len(upto)]
    back = [(bisect_right(upto, after - min_words) - 1, i) for i, after in enumerate(upto[1:]) if after >= min_words]
    return list(dict.fromkeys(onward + back))


def least_lines(marks: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The smallest line hash (its first 8 bytes, signed) of each window, and where it is."""
    own = [(int.from_bytes(marks[i : i + 8], "big", signed=True), i // 16) for i in range(0, len(marks), 16)]
    return [min(own[first : last + 1]) for first, last in found]


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash, marks, words`` of every text with lines; 16 bytes and a count per line."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text_or_empty(text_col).alias("text"))
    schema = T.StructType().add(rows.schema["id"]).add("hash", "long").add("marks", "binary").add("words", T.ArrayType(T.IntegerType()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marked(text.as_py()) for text in batch.column("text")]
            marks, words = pa.array([m for m, _ in found], pa.binary()), pa.array([w for _, w in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hash"), marks, words], schema.names)

    return rows.mapInArrow(each, schema)


def _chosen(lines: DataFrame, min_words: int) -> DataFrame:
    """``id, hash, fingerprint, places``: the lines that windows choose, and at how many places."""
    schema = T.StructType().add(lines.schema["id"]).add("hash", "long").add("fingerprint", "long").add("places", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, chosen, places = [], [], []
            for i, (marks, words) in enumerate(zip(batch.column("marks"), batch.column("words"))):
                marks = marks.as_py()
                counts = Counter(least for least, _ in set(least_lines(marks, windows(words.as_py(), min_words))))
                owner += [i] * len(counts)
                chosen += counts.keys()
                places += counts.values()
            at = pa.array(owner, pa.int64())
            own = [batch.column("id").take(at), batch.column("hash").take(at)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(chosen, pa.int64()), pa.array(places, pa.int64())], schema.names)

    return lines.mapInArrow(each, schema)


def _extended(lines: DataFrame, min_words: int) -> DataFrame:
    """``fingerprint, content, id, hash, first, last``: of texts with ``hits``, the windows that
    choose one of these, each with a hash of its whole content."""
    schema = T.StructType().add("fingerprint", "long").add("content", "binary").add(lines.schema["id"]).add("hash", "long")
    schema = schema.add("first", "integer").add("last", "integer")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, (marks, words, hits) in enumerate(zip(*(batch.column(c) for c in ("marks", "words", "hits")))):
                marks, hits = marks.as_py(), set(hits.as_py())
                found = windows(words.as_py(), min_words)
                for (least, _), (first, last) in zip(least_lines(marks, found), found):
                    if least in hits:
                        owner.append(i)
                        rows.append((least, xxhash.xxh3_128_digest(marks[first * 16 : last * 16 + 16]), first, last))
            fingerprint, content, first, last = zip(*rows) if rows else [()] * 4
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fingerprint, pa.int64()), pa.array(content, pa.binary()), batch.column("id").take(at),
                    batch.column("hash").take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                ],
                schema.names,
            )

    return lines.mapInArrow(each, schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``id, hash, runs``: per text the windows (first and last line with words) that occur earlier.

    Earlier is a smaller id or, in one text, a smaller line. How often a line is chosen comes
    from partial sums, and the first occurrence of a window from a partial minimum; both are
    looked up in joins that adaptive execution can split, so a passage that a third of all
    texts share is no single group.
    """
    lines = staged(_marked(docs, id_col, text_col), "lines")
    chosen = staged(_chosen(lines, min_words), "chosen")
    often = chosen.groupBy("fingerprint").agg(F.sum("places").alias("n")).where("n > 1")
    met = chosen.join(staged(often.select("fingerprint"), "met"), "fingerprint")
    met = met.groupBy(F.col("id").alias("of"), F.col("hash").alias("of_hash")).agg(F.collect_set("fingerprint").alias("hits"))
    some = lines.join(staged(met, "hits"), F.expr("id <=> of and hash = of_hash")).select("id", "hash", "marks", "words", "hits")
    found = staged(_extended(some, min_words), "windows")
    place = F.struct("id", "hash", "first")
    first = found.groupBy("fingerprint", "content").agg(F.min(place).alias("origin"), F.count("*").alias("n"))
    first = staged(first.where(F.col("n") > 1).select("fingerprint", "content", "origin"), "origins")
    later = found.join(first, ["fingerprint", "content"]).where(place > F.col("origin"))
    return later.groupBy("id", "hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the lines of ``runs``; lines with words, removed ones, and maximal runs.

    Empty lines inside a run go with it. A text whose lines with words are all removed is
    empty.
    """
    lines, places = _lines(text)
    gone = bytearray(len(lines))
    for first, last in runs:
        first, last = places[first], places[last]
        gone[first : last + 1] = b"\x01" * (last + 1 - first)
    removed = [gone[i] for i in places]
    n_runs = sum(1 for before, now in zip([0, *removed], removed) if now and not before)
    if not n_runs:
        return text, len(places), 0, 0
    kept = "" if all(removed) else "\n".join(line for line, g in zip(text.split("\n"), gone) if not g)
    return kept, len(places), sum(removed), n_runs


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50
) -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``kept_text, n_lines, n_removed, n_runs``.

    Lines compare without white space at their ends; lines without words count for
    nothing. A null text is empty. Rows of one id are told apart by their texts; rows that
    repeat id and text count as one occurrence and get equal results; a null id is the
    smallest. Whole texts are read, whatever their length. Columns may have any name. An
    empty table yields an empty result.
    """
    runs = staged(repeated_runs(docs, id_col, text_col, min_words), "runs")
    runs = runs.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "runs")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    # A merge join at every size: whether the runs are few must not decide how texts travel.
    rows = rows.join(runs.hint("merge"), F.expr("id <=> of") & (F.col("hash") == F.col("of_hash")), "left")
    rows = rows.select("row", text_or_empty(F.col("row").getField(text_col)).alias("text"), "runs")
    names = ["row", "kept_text", "n_lines", "n_removed", "n_runs"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("runs")):
                out.append(without(text.as_py(), [(r["first"], r["last"]) for r in found.as_py() or ()]))
            columns = zip(*out) if out else [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = rows.select("row").schema.add("kept_text", "string")
    for name in names[2:]:
        schema = schema.add(name, "long")
    return rows.mapInArrow(each, schema)


def sql(table: str, min_words: int = 50) -> str:
    """The same for a second engine; ids must be unique."""
    white = r"[\x20\x09-\x0D]"
    return rf"""
with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos from {table}),
l as (select *, regexp_replace(line, '^{white}+|{white}+$', '', 'g') k, len(regexp_extract_all(line, '{WORDS}')) w from raw),
s as (select *, row_number() over (partition by doc_id order by pos) i, sum(w) over (partition by doc_id order by pos) upto from l where w > 0),
w as (select a.doc_id, a.i, a.pos first, b.i j, b.pos last from s a asof join s b on a.doc_id = b.doc_id and b.upto >= a.upto - a.w + {min_words}
    union select a.doc_id, b.i, b.pos, a.i, a.pos from s a asof join s b on a.doc_id = b.doc_id and b.upto - b.w <= a.upto - {min_words}),
c as (select w.doc_id, w.i, first, last, string_agg(s.k, chr(10) order by s.i) content
    from w join s on s.doc_id = w.doc_id and s.i between w.i and w.j group by all),
f as (select *, row_number() over (partition by content order by doc_id, i) n from c),
g as (select distinct l.doc_id, l.pos from l join f on f.n > 1 and f.doc_id = l.doc_id and l.pos between f.first and f.last),
m as (select l.*, g.pos is not null gone from l left join g on g.doc_id = l.doc_id and g.pos = l.pos),
n as (select *, lag(gone, 1, false) over (partition by doc_id order by pos) before from m where w > 0),
t as (select doc_id, count(*) n_lines, count_if(gone) n_removed, count_if(gone and not before) n_runs from n group by 1)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, coalesce(n_runs, 0) n_runs,
    case when coalesce(n_removed, 0) = 0 then coalesce(d.text, '') when n_removed = n_lines then ''
    else (select string_agg(line, chr(10) order by pos) from m where m.doc_id = d.doc_id and not gone) end kept_text
from {table} d left join t on t.doc_id = d.doc_id"""
