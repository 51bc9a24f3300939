from __future__ import annotations

import re

from tests.llm.conftest import SAME, prose
from tidewater.llm import substring

SPACE = "[ \t\n\x0b\x0c\r]+"


def brute(rows: list[tuple[int, str]], width: int) -> list[tuple]:
    """Intervals by a dictionary of all windows, documents in the order of their ids."""
    where: dict[tuple, list] = {}
    for i, text in sorted(rows):
        t = [x for x in re.split(SPACE, text) if x]
        for p in range(len(t) - width + 1):
            where.setdefault(tuple(t[p : p + width]), []).append((i, p))
    marks: dict[tuple, list] = {}
    for at in where.values():
        for k, (i, p) in enumerate(at):
            if len(at) > 1:
                marks.setdefault((i, "remove" if k else "keep"), []).append(p)
    out = []
    for (i, action), ps in marks.items():
        spans: list[list[int]] = []
        for p in sorted(ps):
            if spans and p <= spans[-1][1]:
                spans[-1][1] = p + width
            else:
                spans.append([p, p + width])
        out += [(i, a, b, b - a, action) for a, b in spans]
    return sorted(out)


def test_against_brute_force(documents):
    a, b = prose(20, 70), prose(21, 30)
    rows = [(1, f"{prose(22, 40)} {a} {prose(23, 10)}"), (2, f"{a}\n{b}"), (3, f"{prose(24, 5)}\t{b} {a} {a}"), (4, prose(25, 100)), (5, f"{b} {b} {b}"), (6, "x " * 120)]
    docs = documents(rows)
    for width in (12, 50):
        for chunk in (60, 2_000_000):
            old, substring.CHUNK = substring.CHUNK, chunk
            try:
                got = sorted(tuple(r) for r in substring.repeated_passages(docs, width, 1 if chunk == 60 else None).collect())
            finally:
                substring.CHUNK = old
            assert got == brute(rows, width)


def test_tables_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in substring.repeated_passages(docs).collect()) == brute(rows, 50)


def test_cut():
    assert substring.cut_tokens("a  b c\nd e ", [(1, 3)]) == "a  d e "
    assert substring.cut_tokens("a b", [(0, 2)]) == ""
    assert substring.cut_tokens(" a b c", [(0, 1), (2, 3)]) == " b "


def test_drop_keeps_the_first(documents):
    rows = [(2, f"start two {SAME}"), (1, f"one {SAME} end"), (3, SAME)]
    got = {r[0]: r for r in substring.drop_repeats(documents(rows)).collect()}
    assert got[1][1] == rows[1][1]
    assert got[2][1] == "start two "
    assert got[3][1] == "" and got[3][4] == 0


def test_edges(edge, empty):
    got = [tuple(r) for r in substring.repeated_passages(edge).collect()]
    by_doc = {(i, action) for i, *_, action in got}
    assert (6, "remove") in by_doc and (5, "keep") in by_doc
    assert not {i for i, *_ in got} & {None, 1, 2, 3, 9, 10}
    out = substring.drop_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    texts = {(r[0], r[1]) for r in out.collect()}
    assert (5, SAME) in texts and (6, "") in texts and (1, None) in texts and (2, "") in texts
    assert substring.repeated_passages(empty).count() == 0
    assert substring.drop_repeats(empty).count() == 0
