"""Substring and line dedup against brute force."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from matchlode.llm.line_dedup import DIVISOR, chunks, remove_repeated_lines
from matchlode.llm.substring_dedup import _glued, _sources, remove_repeated_spans, unitigs
from tests.llm.test_models import thue_morse


def brute_spans(rows, width=13):
    starts = {}
    for doc, text, *_ in rows:
        if doc is not None:
            w = (text or "").encode().split()
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                starts[key] = min(starts.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(w) - width + 1):
                if starts[tuple(w[i : i + width])] < doc:
                    gone |= set(range(i, i + width))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def spans(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_spans(df).collect()), key=str)


def word_rows(seed, n, size=60, vocabulary=300):
    rnd = random.Random(seed)
    passages = [[f"p{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(10, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        while len(w) < rnd.randrange(1, size):
            w += rnd.choice(passages) if rnd.random() < 0.4 else [f"w{rnd.randrange(vocabulary)}" for _ in range(5)]
        rows.append((i, " ".join(w)))
    return rows


def test_spans_match_brute_force(frame):
    rows = word_rows(1, 80)
    assert spans(frame(rows)) == brute_spans(rows)


def test_spans_edges(frame):
    long = " ".join(f"x{i % 997}" for i in range(6000))
    same = " ".join(f"y{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, same), (5, same + " tail"), (6, "a " * 40), (7, "a " * 30), (8, long), (9, "head " + long), (4, same), (None, same), (10, "é ü " * 14), (11, "é ü " * 14)]
    assert spans(frame(rows)) == brute_spans(rows)


def test_windows_are_told_apart_by_more_than_a_polynomial(frame):
    one, other = thue_morse("a", "b"), thue_morse("b", "a")
    tail = " ".join(f"y{i}" for i in range(12))
    rows = [(1, f"{other} {tail}"), (2, f"{one} {tail}"), (3, f"{one} {tail}")]
    assert [(d, n) for d, _, n, _ in spans(frame(rows))] == [(1, 0), (2, 0), (3, 13)]


def test_edges_of_equal_first_lanes_are_told_apart():
    edge, edge2 = np.array([7, 7, 7, 7], np.uint64), np.array([1, 2, 2, 1], np.uint64)
    doc, at = np.array([4, 3, 5, 6]), np.array([0, 10, 20, 30])
    assert [x.tolist() for x in _sources(edge, edge2, doc, at)] == [[4, 3, 3, 4], [0, 10, 10, 0]]


def test_fragments_compact_where_nodes_do_not_branch(spark):
    rows = [(1, 0, 5, 10, 11), (1, 5, 3, 11, 12), (1, 8, 2, 12, 13), (2, 0, 4, 20, 12), (1, 20, 2, 13, 14), (3, 7, 1, 30, 31), (4, 8, 1, 31, 32)]
    made = spark.createDataFrame(rows, "sdoc long, sat long, n long, left long, right long")
    heads = unitigs(made)
    # two fragments lead to node 12; 13 and 31 are between fragments that do not follow each other in a source
    assert sorted(map(tuple, heads.collect())) == [(1, 0, 0), (1, 5, 0), (1, 8, 8), (1, 20, 20), (2, 0, 0), (3, 7, 7), (4, 8, 8)]
    paths = [(9, 100, 5, 1, 0, 0), (9, 105, 3, 1, 5, 5), (9, 108, 2, 1, 8, 8), (9, 200, 2, 1, 6, 5), (9, 300, 2, 7, 3, 3), (8, 105, 3, 1, 5, 5)]
    glued = _glued(spark.createDataFrame(paths, "doc_id long, at long, n long, sdoc long, sat long, frag long"), heads)
    assert sorted(map(tuple, glued.collect())) == [(8, 105, 3, 1, 5), (9, 100, 8, 1, 0), (9, 108, 2, 1, 8), (9, 200, 2, 1, 6), (9, 300, 2, 7, 3)]


def test_spans_of_an_id_with_two_texts(frame):
    a, b = (" ".join(f"{c}{i}" for i in range(15)) for c in "ab")
    rows = [(1, a), (1, b), (2, b + " " + a), (2, a)]
    assert spans(frame(rows)) == brute_spans(rows)


def test_spans_name_the_removed_words(frame):
    same = " ".join(f"y{i}" for i in range(14))
    got = {r.doc_id: [(s.first, s["last"]) for s in r.spans] for r in remove_repeated_spans(frame([(1, same), (2, "q " + same + " r")])).collect()}
    assert got == {1: [], 2: [(1, 14)]}


def test_spans_of_an_empty_table(frame, spark):
    assert remove_repeated_spans(frame([(1, "a")]).filter("false")).count() == 0


def test_spans_refuse_a_wide_seed(frame):
    with pytest.raises(ValueError):
        remove_repeated_spans(frame([(1, "a")]), width=5, seed=6)


def cut_lines(text):
    """Chunks by their definition: a line ends one if the two checksums up to it hash to 0 modulo DIVISOR, but a first line only at the end."""
    out, own = [], []
    lines = text.encode().split(b"\n")
    for i, line in enumerate(lines):
        own.append(line)
        both = b"".join(zlib.crc32(x).to_bytes(4, "little") for x in lines[max(0, i - 1) : i + 1])
        if i == len(lines) - 1 or len(own) > 1 and xxhash.xxh64_intdigest(both) % DIVISOR == 0:
            out.append(own)
            own = []
    return out


def brute_lines(rows):
    seen, out = set(), []
    for doc, text, *_ in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        left, gone = [], 0
        for chunk in cut_lines(text) if text else []:
            known = len(chunk) > 1 and b"".join(chunk).split() and tuple(chunk) in seen
            seen.add(tuple(chunk))
            gone += len(chunk) if known else 0
            left += [] if known else chunk
        out += [(doc, b"\n".join(left).decode() if text is not None else None, gone)] * sum(r[0] == doc and r[1] == text for r in rows)
    return sorted(out, key=str)


def lines(df):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in remove_repeated_lines(df).collect()), key=str)


def line_rows(seed, n):
    rnd = random.Random(seed)
    common = [[f"common {k} {j}" for j in range(rnd.randrange(3, 12))] for k in range(5)]
    rows = []
    for i in range(n):
        ls = [f"own {i} {j}" for j in range(rnd.randrange(0, 6))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(ls) + 1)
            ls[at:at] = rnd.choice(common)
        rows.append((i, "\n".join(ls)))
    return rows


def test_lines_match_brute_force(frame):
    rows = line_rows(2, 60)
    assert lines(frame(rows)) == brute_lines(rows)
    assert sum(r[2] for r in lines(frame(rows))) > 0


def test_lines_edges(frame):
    block = "\n".join(f"line {i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, block), (5, block + "\nmore"), (6, "single"), (7, "single"), (8, block + "\n" + block), (4, block), (9, "\r\n" + block)]
    assert lines(frame(rows)) == brute_lines(rows)


def test_lines_keep_rows_without_id(frame):
    block = "\n".join(f"line {i}" for i in range(12))
    got = lines(frame([(1, block), (None, block)]))
    assert [r[1] for r in got] == [block, block]


def test_bounds_of_chunks_follow_the_content():
    a = b"\n".join(b"row %d" % i for i in range(200))
    before, after = {c for *_, c in chunks(a)}, {c for *_, c in chunks(b"new\n" + a)}
    assert len(before & after) >= len(before) - 2
    assert b"\n".join(c for *_, c in chunks(a)) == a
