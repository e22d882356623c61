"""Line dedup by runs against all repeated runs of lines."""

import random

from matchlode.llm.line_dedup import remove_repeated_lines
from tests.llm.test_spans_and_lines import line_rows


def brute_runs(rows):
    """Each occurrence of a run of two lines but the first goes; of three equal lines two stay."""
    seen, out = set(), []
    for doc, text in sorted({r for r in rows if r[0] is not None}):
        ls, go = text.split("\n"), set()
        if len(ls) == 1 and text.split():
            go = {0} if (text,) in seen else set()
            seen.add((text,))
        for i in range(len(ls) - 1):
            pair = (ls[i], ls[i + 1])
            if not "".join(pair).split():
                continue
            if pair in seen:
                go |= {i + 1} if i and (ls[i - 1], ls[i]) == pair else {i, i + 1}
            seen.add(pair)
        left = "\n".join(x for i, x in enumerate(ls) if i not in go)
        out += [(doc, left, len(go))] * rows.count((doc, text))
    return sorted(out)


def removed(df):
    return sorted((r.doc_id, r.text, r.n_removed) for r in remove_repeated_lines(df, runs=True).collect())


def test_all_repeated_runs_go(frame):
    rows = line_rows(2, 60)
    assert removed(frame(rows)) == brute_runs(rows)
    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 9)))) for i in range(30)]
    assert removed(frame(rows)) == brute_runs(rows)


def test_every_later_copy_of_a_text_loses_all_words(frame):
    texts = ["one line", "a\nb", "a 1\nb 2\nc 3", "\n".join(f"line {i}" for i in range(12))]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(3)]
    assert [(d, n) for d, t, n in removed(frame(rows)) if d % 10] == [(10 * i + k, t.count("\n") + 1) for i, t in enumerate(texts) for k in (1, 2)]


def test_lines_next_to_a_run_stay(frame):
    rows = [(1, "p\nA\nB\nC\nq"), (2, "x\nA\nB\nC\ny"), (3, "A\nx"), (4, "\n\n"), (5, "\n\n")]
    assert removed(frame(rows)) == [(1, "p\nA\nB\nC\nq", 0), (2, "x\ny", 3), (3, "A\nx", 0), (4, "\n\n", 0), (5, "\n\n", 0)]
    got = {(r.doc_id, r.text, r.n_lines) for r in remove_repeated_lines(frame([(1, None), (2, ""), (None, "a\nb"), (3, "a\nb")]), runs=True).collect()}
    assert got == {(1, None, 0), (2, "", 0), (None, "a\nb", 2), (3, "a\nb", 2)}
