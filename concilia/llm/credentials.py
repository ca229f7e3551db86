"""Secret scans: patterns that stand alone, and weak parts of a credential that co-occur.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported by
themselves. Weaker ones - a bare 40-character key, an identifier assignment, an endpoint -
are reported only where complementary parts begin within ``scope`` characters. The linking
is an interval join on bins as wide as the scope: per document, role and bin only the first
and the last position travel, which answers "is one within reach?" without pairing parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, text_or_empty

#: Kinds in the order in which spans at one position are listed.
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_IDENTIFIER = re.compile(
    r"""(?:access|client|account|tenant|app|user)[_-]?(?:key[_-]?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})""",
    re.IGNORECASE | re.ASCII,
)
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]{4,}""", re.IGNORECASE | re.ASCII)
_HEX_RUN, _KEY_RUN = b"h" * 32, b"k" * 40
_HEX_TABLE = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_KEY_TABLE = bytes(107 if b < 128 and (chr(b).isalnum() or chr(b) in "+/") else 32 for b in range(256))


def strong_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points of the patterns that stand alone.

    Cheap tests of whole texts come first; they only skip texts that cannot match.
    """
    spans = []
    lower = data.lower()
    if any(word.encode() in lower for word in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if _HEX_RUN in data.translate(_HEX_TABLE):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def weak_spans(text: str, data: bytes, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no strong span; none where no complement can be in the text."""
    spans = []
    if _KEY_RUN in data.translate(_KEY_TABLE):
        for m in _SECRET.finditer(text):
            if any(map(str.isdigit, m[0])) and any(map(str.isupper, m[0])) and any(map(str.islower, m[0])):
                spans.append((m.start(), 3, m.end()))
    if not spans and not strong:
        return []
    spans += [(m.start(), 4, m.end()) for m in _IDENTIFIER.finditer(text)]
    spans += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    return sorted(_apart(spans, strong))


def _apart(spans, taken):
    taken = sorted((a, b) for a, _, b in taken)
    at, reach = 0, -1
    for start, kind, end in sorted(spans):
        while at < len(taken) and taken[at][0] < end:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach <= start:
            yield start, kind, end


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, hash, strong, weak`` of every row; spans are sorted structs ``start, kind, end``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), text_or_empty(text_col).alias("text"))
    kept = ["id", "hash"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strong, weak = [], []
            for value in batch.column("text"):
                text = value.as_py()
                data = text.encode()
                strong.append(found := strong_spans(text, data))
                weak.append(weak_spans(text, data, found))
            spans = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in row] for row in part], pa.list_(_SPAN)) for part in (strong, weak)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *spans], [*kept, "strong", "weak"])

    span = T.StructType().add("start", "long").add("kind", "integer").add("end", "long")
    schema = rows.select(*kept).schema.add("strong", T.ArrayType(span)).add("weak", T.ArrayType(span))
    return rows.mapInArrow(each, schema)


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """``id, hash, confirmed``: per document the weak spans with complements within ``scope``.

    A bare key needs an identifier, an identifier a key or secret, an endpoint both.
    ``parts`` has ``id, hash, strong, weak``.
    """
    weak = parts.where(F.size("weak") > 0)
    every = weak.select("id", "hash", F.explode(F.concat("strong", "weak")).alias("span"))
    bins = F.floor(F.col("span.start") / scope)
    role = F.when(F.col("span.kind").isin(1, 4), "who").when(F.col("span.kind").isin(0, 3), "key")
    found = every.select("id", "hash", role.alias("role"), bins.alias("bin"), F.col("span.start").alias("at")).where("role is not null")
    found = found.groupBy("id", "hash", "role", "bin").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    asks = weak.select("id", "hash", F.explode("weak").alias("span")).distinct()
    asks = asks.withColumn("bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    right = found.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), F.col("bin").alias("of_bin"), "role", "low", "high")
    near = asks.join(right, F.expr("id <=> of") & (F.col("hash") == F.col("of_hash")) & (F.col("bin") == F.col("of_bin")))
    # In the span's own bin everything is within reach; next to it, the nearest end decides.
    near = near.where((F.col("high") >= F.col("span.start") - scope) & (F.col("low") <= F.col("span.start") + scope))
    flags = near.groupBy("id", "hash", "span").agg(
        F.bool_or(F.col("role") == "who").alias("who"), F.bool_or(F.col("role") == "key").alias("key")
    )
    kind = F.col("span.kind")
    enough = F.when(kind == 3, F.col("who")).when(kind == 4, F.col("key")).otherwise(F.col("who") & F.col("key"))
    return flags.where(enough).groupBy("id", "hash").agg(F.collect_list("span").alias("confirmed"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """``doc_id, base, spans`` for every row of ``docs``: sorted arrays of structs
    ``start, kind, end`` (code points, end exclusive; ``kind`` numbers ``KINDS``).

    ``spans`` holds the base spans and the confirmed weak ones. A null text is empty. Rows
    of one id are linked by text, so repeated rows get equal results and others do not
    mix; a null id is an id like any other. Other columns are not read. An empty table
    yields an empty result.
    """
    seen = staged(scan(docs, id_col, text_col), "spans")
    found = linked(seen.select("id", "hash", "strong", "weak"), scope)
    found = found.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "confirmed")
    both = seen.join(found, F.expr("id <=> of") & (F.col("hash") == F.col("of_hash")), "left")
    none = F.array().cast(both.schema["strong"].dataType)
    return both.select(F.col("id").alias("doc_id"), F.col("strong").alias("base"), F.array_sort(F.concat("strong", F.coalesce("confirmed", none))).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")
