"""SimHash, line and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from concilia.llm import lines, simhash, suffixes
from concilia.llm.components import components
from tests.llm.data import awkward, documents, texts


def simhash_of(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).translate({c: 32 for c in range(9, 14)})
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    mark = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return mark - (1 << 64) if mark >> 63 else mark


def test_fingerprints_are_those_of_the_definition():
    for text in texts():
        assert simhash.fingerprint((text or "").encode()) == simhash_of(text)


def test_every_close_fingerprint_meets_at_a_home_anchor():
    rng, code, home = random.Random(1), simhash.Golay(2), simhash.Golay(0)
    for _ in range(200):
        a = rng.getrandbits(64)
        bits = rng.sample(range(64), rng.randint(0, 2))
        b = a
        for bit in bits:
            b ^= 1 << bit
        a, b = np.array([[a], [b]], np.uint64).view(np.int64)
        own = simhash._anchor_rows(home, a, 2).column("anchor").to_pylist()
        copies = simhash._anchor_rows(code, b, 2).column("anchor").to_pylist()
        assert len(own) == 1 and own[0] in copies and len(copies) == len(set(copies))


def test_anchors_cover_all_words():
    code = simhash.Golay(0)
    words = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    errors = np.array([code.near[0][s][0] for s in code.syndrome(words)])
    assert (code.syndrome(words ^ errors) == 0).all()
    assert max(bin(e).count("1") for e in errors) == 3


def brute_components(marks):
    label = {m: m for m in marks}
    known = sorted(marks)
    changed = True
    while changed:
        changed = False
        for a in known:
            for b in known:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_components_of_documents(spark):
    rows = awkward()
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    marks = [(i, simhash_of(t)) for i, t, *_ in rows]
    label = brute_components({m for _, m in marks})
    least = {}
    for i, m in marks:
        if i is not None:
            least[label[m]] = min(i, least.get(label[m], i))
    want = sorted((str(i), m, least.get(label[m])) for i, m in marks)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_links_of_fingerprints_near_each_other(spark):
    rng = random.Random(3)
    marks = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            marks.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    marks = [m - (1 << 64) if m >> 63 else m for m in marks]
    got = simhash.links(spark.createDataFrame([(m,) for m in marks], "mark long"), 2).collect()
    want = {(a, b) for a in marks for b in marks if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)} | {201: 200}
    assert got == want


def brute_lines(rows, min_words=50):
    """Lines that lie in any run of min_words words or more which occurs earlier."""
    keys = sorted({(i is not None, i or 0, t or "") for i, t, *_ in rows}, key=lambda k: (k[0], k[1], xx(k[2])))
    seen, out = set(), {}
    for key in keys:
        parts = [p.strip(" \t\n\r\x0b\x0c") for p in key[2].split("\n")]
        places = [n for n, p in enumerate(parts) if p]
        words, gone = [len(parts[n].encode().split()) for n in places], set()
        for s in range(len(places)):
            for e in range(s + 1, len(places) + 1):
                if sum(words[s:e]) >= min_words:
                    content = tuple(parts[n] for n in places[s:e])
                    if content in seen:
                        gone |= set(range(places[s], places[e - 1] + 1))
                    seen.add(content)
        left = [n for n in places if n not in gone]
        kept = key[2] if not gone else "\n".join(p for n, p in enumerate(key[2].split("\n")) if n not in gone) if left else ""
        out[key] = (len(places), len(places) - len(left), kept)
    return out


def xx(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def test_line_dedup(spark):
    rows = [r for r in awkward() if r[1] is not None or r[0] is not None]
    got = lines.dedup_lines(documents(spark, rows)).select("row.doc_id", "row.text", "n_lines", "n_removed", "kept_text").collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept_text) == want[(r.doc_id is not None, r.doc_id or 0, r.text or "")]
    assert sum(r.n_removed for r in got) > 20


def test_a_long_line_is_a_window_by_itself(spark):
    long = " ".join(f"w{i}" for i in range(51))
    got = lines.dedup_lines(documents(spark, [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "a\nb\nc")])).collect()
    assert {r.row.doc_id: r.kept_text for r in got} == {1: f"a\n{long}\nb", 2: "c\nd", 3: "", 4: "a\nb\nc"}


def test_whole_runs_go_to_their_last_line(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    run = [line("a", 45), line("b", 10), line("c", 30)]
    rows = [(1, "\n".join([line("x", 9), *run, line("y", 70)])), (2, "\n".join([line("p", 60), *run, "", line("q", 60)]))]
    got = {r.row.doc_id: r for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 3
    assert got[2].kept_text == "\n".join([line("p", 60), "", line("q", 60)])
    rng = random.Random(12)
    pool = [line(f"l{k}w", rng.choice([3, 10, 20, 30, 45, 60])) for k in range(12)]
    rows = []
    for i in range(60):
        at = rng.randrange(8)
        rows.append((i, "\n".join([line(f"d{i}_", rng.randint(1, 60)), *pool[at : at + rng.randint(1, 6)], line(f"e{i}_", rng.randint(1, 60))])))
    got = {r.row.doc_id: r.n_removed for r in lines.dedup_lines(documents(spark, rows)).collect()}
    assert got == {k[1]: v[1] for k, v in brute_lines(rows).items()} and sum(got.values()) > 50


def test_only_lines_that_meet_are_extended(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, "\n".join(line(f"d{i}l{k}w", 20) for k in range(30))) for i in range(5)] + [(9, line("d0l1w", 20) + "\n" + line("x", 60))]
    found = lines._chosen(lines._marked(documents(spark, rows), "doc_id", "text"), 50)
    chosen = found.groupBy("id").agg(F.sum("places").alias("n")).where("id < 5").collect()
    assert all(5 <= r.n <= 29 for r in chosen)  # some of 30 lines, each window one of them
    assert lines.repeated_runs(documents(spark, rows)).count() == 0


def brute_bytes(rows, width):
    seen, out = set(), {}
    keys = {(i if i is not None else -(2**63), t or "") for i, t, *_ in rows}
    for i, text in sorted(keys):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            window = data[p : p + width]
            if window in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        out[i, text] = (len(data), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_substring_dedup(spark, limit):
    rows = [r for r in awkward() if (r[0], r[1]) != (awkward()[15][0], awkward()[20][1])]
    got = suffixes.dedup_substrings(documents(spark, rows), group_limit=limit).collect()
    want = brute_bytes(rows, 100)
    expected = sorted((str(i), *want[i if i is not None else -(2**63), t or ""]) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expected
    assert sum(r.n_removed for r in got) > 5000


def test_substring_dedup_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 37)  # sent along by value
    rows = [(i, t) for i, t in enumerate(texts(9, 24))]
    got = suffixes.dedup_substrings(documents(spark, rows), width=80).collect()
    want = brute_bytes(rows, 80)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == {i: want[i, t or ""] for i, t in rows}


def test_previous_factors_against_their_definition():
    rng = random.Random(0)
    for _ in range(30):
        text = "".join(rng.choice("ab") for _ in range(40))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or max(a, b) + k >= len(text)), 0)
        lcp = [0] + [common(a, b) for a, b in zip(order, order[1:])]
        got = suffixes.previous_factors(np.array(order), np.array(lcp))
        assert got.tolist() == [max([common(i, j) for j in range(i)], default=0) for i in range(len(text))]


def test_windows_with_equals_are_ranked_by_their_bytes():
    data = (texts()[12] * 2 + texts()[20] + texts()[12]).encode()
    starts = np.arange(len(data) - 99)
    numbers = starts // 500
    chosen, ranks = suffixes._prefix_order(suffixes._words(data), starts, numbers, 100)
    kinds = [(n, data[i : i + 100]) for i, n in zip(starts, numbers)]
    assert chosen.tolist() == [i for i in starts if kinds.count(kinds[i]) > 1] and len(chosen)
    assert [kinds[i] for i in chosen[np.argsort(ranks, kind="stable")]] == sorted(kinds[i] for i in chosen)
    assert len(set(ranks.tolist())) == len({kinds[i] for i in chosen})


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert suffixes.dedup_substrings(none).count() == 0


def test_a_digest_of_the_kept_bytes(spark):
    got = suffixes.dedup_substrings(documents(spark, [(1, "a" * 50)])).select(F.sha2("kept", 256)).first()[0]
    assert got == hashlib.sha256(b"a" * 50).hexdigest()
