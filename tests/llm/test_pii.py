from __future__ import annotations

import itertools

import numpy as np
import pytest

from tests.llm.conftest import EDGE
from tidewater.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.model()


def every(n: int, spans: list[tuple[int, int]]):
    """All segmentations of n tokens into single outside tokens and typed segments."""

    def go(at: int):
        if at == n:
            yield []
            return
        for rest in go(at + 1):
            yield [(at, at + 1, 0), *rest]
        for i, j in spans:
            if i == at:
                for rest in go(j):
                    for t in range(1, len(pii.TYPES)):
                        yield [(i, j, t), *rest]

    yield from go(0)


def test_decoding_and_likelihood_against_all_segmentations():
    rng = np.random.default_rng(3)
    for tokens in (["call", "+49", "(030)", "555-1234", "x"], ["a@b.org", "4111111111111111", "10.0.0.1"], ["no", "digits"]):
        f = pii.Field()
        hot = [bool(pii._HOT.search(t)) for t in tokens]
        rows = f.rows(tokens, hot, grow=True)
        f.w, f.move = rng.normal(size=f.w.shape), rng.normal(size=f.move.shape)

        def score(segments):
            total, t0 = 0.0, 0
            for i, j, t in segments:
                total += f.move[t0, t] + (f.w[t, rows[i, j]].sum() if t else 0.0)
                t0 = t
            return total

        found = list(every(len(tokens), list(rows)))
        best = max(found, key=score)
        assert f.best(len(tokens), rows) == [s for s in best if s[2]]
        z = np.log(sum(np.exp(score(s)) for s in found))
        for s in itertools.islice(found, 0, None, 7):
            gold = [x for x in s if x[2]]
            assert f.gradient(len(tokens), rows, gold)[0] == pytest.approx(score(s) - z)


def test_gradient_is_the_slope():
    rng = np.random.default_rng(4)
    tokens = ["key", "=", "deadbeefdeadbeefdeadbeefdeadbeef", "1.2.3.4"]
    f = pii.Field()
    rows = f.rows(tokens, [bool(pii._HOT.search(t)) for t in tokens], grow=True)
    f.w, f.move = rng.normal(size=f.w.shape), rng.normal(size=f.move.shape)
    gold = [(3, 4, 3)]
    value, gw, gm = f.gradient(4, rows, gold)
    for array, slope in ((f.w, gw), (f.move, gm)):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(8)]:
            array[at] += 1e-5
            assert (f.gradient(4, rows, gold)[0] - value) / 1e-5 == pytest.approx(slope[at], abs=1e-3)
            array[at] -= 1e-5


FOUND = [
    ("mail jo.do7@mail3.example.com now", "jo.do7@mail3.example.com", "EMAIL"), ("write to ann_lee@site.org.", "ann_lee@site.org", "EMAIL"),
    ("ring +49 (030) 555-1234 today", "+49 (030) 555-1234", "PHONE"), ("or (212) 555-0199, please", "(212) 555-0199", "PHONE"),
    ("from 192.168.10.77 came", "192.168.10.77", "IP"), ("pay with 4111111111111111 then", "4111111111111111", "CARD"),
    ('token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"', "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08", "SECRET"),
]
CLEAN = ["in 1998 the 12 of 345", "version 2.0.1 of C++", "@someone said 3,456", "on 2024-01-15 at 10:30", "price 12.50 and 99%"]


def test_planted(field):
    for text, span, kind in FOUND:
        assert [(text[a:b], k) for a, b, k in pii.spans(text, field)] == [(span, kind)], text
    for text in CLEAN:
        assert pii.spans(text, field) == [], text


def test_held_out_sentences(field):
    """Generated sentences that training didn't see."""
    rng = np.random.default_rng(99)
    right = total = found = 0
    for _ in range(300):
        tokens, gold = pii._sentence(rng)
        got = set(field.best(len(tokens), field.rows(tokens, [bool(pii._HOT.search(t)) for t in tokens])))
        right += len(got & set(gold))
        total += len(gold)
        found += len(got)
    assert right / total > 0.93 and right / found > 0.93


def test_frames(documents, edge, empty, field):
    text = "é " * 50_000 + "mail a.b@mail1.example.com é"
    docs = documents([(1, text), (1, text), (None, "ring +49 (030) 555-1234"), (2, None), (3, "")])
    got = sorted((str(r.doc_id), r.start_char, r.end_char, r.kind) for r in pii.find_pii(docs).collect())
    assert got == sorted([("1", 100_005, 100_005 + 21, "EMAIL")] * 2 + [("None", 5, 23, "PHONE")])
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    rows = {str(r[0]): r for r in out.collect()}
    assert rows["1"][1].endswith("mail [EMAIL] é") and rows["1"][4] == len(rows["1"][1])
    assert rows["None"][1] == "ring [PHONE]" and rows["2"][1] is None
    assert pii.redact_pii(edge).count() == len(EDGE)
    assert pii.find_pii(empty).count() == 0 and pii.redact_pii(empty).count() == 0
