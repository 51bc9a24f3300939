"""Personal data by a semi-Markov conditional random field.

A document is a row of white-space tokens. Segments of up to ``MAX_SEGMENT``
tokens are scored whole: features look at the segment's entire text (its shape,
digits, checksum, what stands before it), not at single tokens. A dynamic
program over segment ends, with bounded segment length, chooses boundaries and
types together. Only tokens with a digit, ``@`` or ``+`` can start or end a
segment; every other token is outside, so blocks of such tokens are independent
and the text between them costs nothing.

The weights are trained here, by gradient ascent on the semi-Markov likelihood
of generated sentences with known segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _text as tx
from tidewater.llm._frame import Placed

TYPES = ("OUT", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
MAX_SEGMENT = 5
_TOKEN = re.compile(r"[^ \t\n\v\f\r]+")
_HOT = re.compile(r"[0-9@+]")
_EDGE_L, _EDGE_R = "\"'([{<«“‘*_|,;:", "\"'.,;:!?)]}>»”’*_|&%$#"
_SHAPES = (
    ("email", re.compile(r"[^\s@\"'(),:;<>\[\]|]+@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}")),
    ("ip", re.compile(r"(?:\d{1,3}\.){3}\d{1,3}")),
    ("intl", re.compile(r"\+\d[\d().\- ]{6,}\d")),
    ("local", re.compile(r"\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}")),
    ("digits", re.compile(r"\d{13,19}")),
    ("fours", re.compile(r"(?:\d{4}[ \-]){3}\d{1,7}")),
    ("hex", re.compile(r"[0-9a-fA-F]{24,}")),
    ("mixed", re.compile(r"(?=[^0-9]*[0-9])(?=[^a-zA-Z]*[a-zA-Z])[\w\-]{20,}")),
    ("number", re.compile(r"[\d.,]+")),
    ("date", re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")),
    ("keyed", re.compile(r"(?:sk|pk|ghp|AKIA|xox)[\w\-]{12,}")),
)
_CUES = {
    "token": "secret", "key": "secret", "secret": "secret", "password": "secret", "passwd": "secret", "api_key": "secret",
    "call": "phone", "phone": "phone", "tel": "phone", "mail": "email", "email": "email", "card": "card", "ip": "ip", "from": "ip",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def trim(text: str) -> tuple[int, int]:
    """Start and end of a segment's core, without the punctuation around it."""
    a, b = 0, len(text)
    while a < b and text[a] in _EDGE_L and not (text[a] == "(" and re.match(r"\(\d+\)", text[a:])):
        a += 1
    while b > a and text[b - 1] in _EDGE_R:
        b -= 1
    return a, b


def features(span: str, tokens: int, before: str) -> list[str]:
    """Features of a whole candidate segment."""
    a, b = trim(span)
    core = span[a:b]
    out = ["bias", f"tokens={tokens}"]
    shapes = [name for name, r in _SHAPES if r.fullmatch(core)]
    out += [f"shape={s}" for s in shapes] or ["shape=none"]
    digits = re.sub(r"\D", "", core)
    out.append(f"digits={min(len(digits), 20) if len(digits) < 13 else '13-19' if len(digits) < 20 else '20+'}")
    if "ip" in shapes:
        out.append("octets" if all(int(x) < 256 for x in core.split(".")) else "not octets")
    if {"digits", "fours"} & set(shapes):
        out.append("luhn" if luhn(digits) else "not luhn")
    if "number" in shapes:
        out.append("long number" if len(digits) >= 13 else "short number")
    out.append(f"at={core.count('@')}")
    cue = _CUES.get(before)
    out += [f"cue={cue}"] + [f"cue={cue}&shape={s}" for s in shapes] if cue else []
    return out


def _cue(tokens: list[str], i: int) -> str:
    """The nearest of the two tokens before i that is a word."""
    for t in reversed(tokens[max(0, i - 2) : i]):
        word = t.strip("\"'=:;,.()[]|").lower()
        if word:
            return word
    return ""


def candidates(tokens: list[str], hot: list[bool]) -> list[tuple[int, int]]:
    """(i, j): segments of tokens i to j-1 that begin and end in a hot token, at most one other in a row between."""
    out = []
    for i in range(len(tokens)):
        if hot[i]:
            for j in range(i + 1, min(i + MAX_SEGMENT, len(tokens)) + 1):
                if hot[j - 1]:
                    out.append((i, j))
                elif j < 2 or not hot[j - 2]:
                    break
    return out


class Field:
    """Weights of (type, feature) and of the change from type to type."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((len(TYPES), 0))
        self.move = np.zeros((len(TYPES), len(TYPES)))

    def rows(self, tokens: list[str], hot: list[bool], grow: bool = False) -> dict[tuple[int, int], list[int]]:
        found = {}
        for i, j in candidates(tokens, hot):
            names = features(" ".join(tokens[i:j]), j - i, _cue(tokens, i))
            if grow:
                for f in names:
                    self.index.setdefault(f, len(self.index))
            found[i, j] = [self.index[f] for f in names if f in self.index]
        if grow and self.w.shape[1] < len(self.index):
            self.w = np.pad(self.w, ((0, 0), (0, len(self.index) - self.w.shape[1])))
        return found

    def best(self, n: int, rows: dict[tuple[int, int], list[int]]) -> list[tuple[int, int, int]]:
        """(i, j, type) of the segments other than OUT of the best segmentation of n tokens."""
        size = len(TYPES)
        score = np.full((n + 1, size), -np.inf)
        back: list[list] = [[None] * size for _ in range(n + 1)]
        score[0, 0] = 0
        ends: dict[int, list] = {}
        for (i, j), f in rows.items():
            ends.setdefault(j, []).append((i, self.w[:, f].sum(1)))
        for j in range(1, n + 1):
            for i, s in [(j - 1, None), *ends.get(j, ())]:
                into = score[i][:, None] + self.move
                src = into.argmax(0)
                for t in [0] if s is None else range(1, size):
                    got = into[src[t], t] + (0 if s is None else s[t])
                    if got > score[j, t]:
                        score[j, t], back[j][t] = got, (i, int(src[t]))
        out, j, t = [], n, int(score[n].argmax())
        while j:
            i, before = back[j][t]
            if t:
                out.append((i, j, t))
            j, t = i, before
        return out[::-1]

    def gradient(self, n: int, rows: dict[tuple[int, int], list[int]], gold: list[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold segments, and its gradients, by the forward-backward recursion over segments."""
        size = len(TYPES)
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for (i, j), f in rows.items():
            s = self.w[:, f].sum(1)
            s[0] = -np.inf
            ends.setdefault(j, []).append((i, s, f))
            starts.setdefault(i, []).append((j, s, f))
        out = np.full(size, -np.inf)
        out[0] = 0
        alpha, beta = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        alpha[0, 0] = 0
        beta[n] = 0

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            top = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

        for j in range(1, n + 1):
            parts = [total(alpha[i][:, None] + self.move, 0) + s for i, s in [(j - 1, out), *((i, s) for i, s, _ in ends.get(j, ()))]]
            alpha[j] = total(np.stack(parts), 0)
        for i in range(n - 1, -1, -1):
            parts = [total(self.move + (s + beta[j])[None, :], 1) for j, s in [(i + 1, out), *((j, s) for j, s, _ in starts.get(i, ()))]]
            beta[i] = total(np.stack(parts), 0)
        z = float(total(alpha[n], 0))
        gw, gm = np.zeros_like(self.w), np.zeros_like(self.move)
        for i in range(n):
            for j, s, f in [(i + 1, out, []), *starts.get(i, ())]:
                p = np.exp(alpha[i][:, None] + self.move + (s + beta[j])[None, :] - z)
                gm -= p
                for x in f:
                    gw[:, x] -= p.sum(0)
        score, t0, at = 0.0, 0, 0
        for i, j, t in [*gold, (n, n, -1)]:
            for _ in range(at, i):
                score += self.move[t0, 0]
                gm[t0, 0] += 1
                t0 = 0
            if t >= 0:
                f = rows[i, j]
                score += self.move[t0, t] + self.w[t, f].sum()
                gm[t0, t] += 1
                for x in f:
                    gw[t, x] += 1
                t0 = t
            at = j
        return score - z, gw, gm


def _sentence(rng: np.random.Generator) -> tuple[list[str], list[tuple[int, int, int]]]:
    """A generated sentence with its segments."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(rng.choice(list("abdeinorstu"), int(rng.integers(1, 9))))

    def card() -> str:
        d = str(rng.integers(3, 7)) + digits(int(rng.choice([14, 14, 14, 13])))
        return next(d + str(x) for x in range(10) if luhn(d + str(x)))

    def one() -> tuple[list[str], int]:
        kind = int(rng.integers(0, 16))
        if kind <= 1:
            return [f"{word()}.{digits(2)}@mail{digits(1)}.{word()}x.com" if kind else f"{word()}{rng.choice(['', '_', '.'])}{word()}@{word()}x.org"], 1
        if kind == 2:
            return [f"+{rng.integers(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], 2
        if kind == 3:
            return [[f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{rng.integers(1, 99)}", digits(3), digits(3), digits(4)], [f"+{digits(11)}"]][int(rng.integers(0, 4))], 2
        if kind <= 5:
            return [".".join(str(x) for x in rng.integers(1, 256, 4))], 3
        if kind == 6:
            return [card()], 4
        if kind == 7:
            c = card().ljust(16, "0")
            return [c[k : k + 4] for k in range(0, 16, 4)], 4
        if kind == 8:
            return [digits(16)], 4
        if kind == 9:
            return ["".join(rng.choice(list("0123456789abcdef"), int(rng.choice([32, 40, 64]))))], 5
        if kind == 10:
            return ["".join(rng.choice(list("0123456789abcdefghijkmnpqrstuvwxyzABCDEFGH"), 28)) + "7a"], 5
        clean = [
            [str(rng.integers(0, 3000))], [f"{digits(2)}.{digits(2)}"], [f"20{digits(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}"], [f"{word()}{digits(1)}"],
            [digits(1), digits(3), digits(2)], [f"{digits(1)},{digits(3)}"], [f"@{word()}"], [".".join(str(x) for x in rng.integers(300, 999, 4))], ["C++"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], ["2.0"],
        ]
        return clean[int(rng.integers(0, len(clean)))], 0

    tokens: list[str] = []
    gold = []
    for _ in range(int(rng.integers(1, 4))):
        tokens += [word() for _ in range(int(rng.integers(0, 4)))]
        part, t = one()
        if t == 5 and rng.random() < 0.7:
            tokens += [str(rng.choice(["token", "key", "secret", "password"])), "="]
        if t == 5 and rng.random() < 0.5:
            part = ['"' + part[0] + '"']
        elif rng.random() < 0.3:
            part = [*part[:-1], part[-1] + str(rng.choice([".", ",", ";"]))]
        if t:
            gold.append((len(tokens), len(tokens) + len(part), t))
        tokens += part
    return tokens + [word()], gold


@lru_cache(1)
def model(sentences: int = 600, epochs: int = 4, rate: float = 0.3, l2: float = 1e-3, seed: int = 11) -> Field:
    """The field trained on ``sentences`` generated sentences: fixed in size, the same in every process."""
    rng = np.random.default_rng(seed)
    field, data = Field(), []
    for _ in range(sentences):
        tokens, gold = _sentence(rng)
        rows = field.rows(tokens, [bool(_HOT.search(t)) for t in tokens], grow=True)
        if all((i, j) in rows for i, j, _ in gold):
            data.append((len(tokens), rows, gold))
    gw, gm = np.full_like(field.w, 1e-3), np.full_like(field.move, 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, dw, dm = field.gradient(*data[k])
            dw, dm = dw - l2 * field.w, dm - l2 * field.move
            gw += dw * dw
            gm += dm * dm
            field.w += rate * dw / np.sqrt(gw)
            field.move += rate * dm / np.sqrt(gm)
    return field


def spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """(start, end, type), in characters, of the personal data in a text."""
    out: list[tuple[int, int, str]] = []
    hot_at = [m.start() for m in _HOT.finditer(text)]
    done = 0
    for h in hot_at:
        if h < done:
            continue
        # the block: tokens around h, as long as one of any two successive tokens is hot
        a = h
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        block, last = [], None
        for m in _TOKEN.finditer(text, a):
            if _HOT.search(m.group()):
                last = len(block)
            elif last is None or len(block) - last > 1:
                break
            block.append(m)
        block = block[: last + 1]
        done = block[-1].end()
        before = [m.group() for m in _TOKEN.finditer(text[max(0, a - 60) : a])][-2:]
        tokens = before + [m.group() for m in block]
        hot = [False] * len(before) + [bool(_HOT.search(m.group())) for m in block]
        for i, j, t in field.best(len(tokens), field.rows(tokens, hot)):
            s, e = block[i - len(before)].start(), block[j - 1 - len(before)].end()
            x, y = trim(text[s:e])
            if y > x:
                out.append((s + x, s + y, TYPES[t]))
    return out


_HOT_BYTES = np.zeros(256, bool)
_HOT_BYTES[list(b"0123456789@+")] = True


def _hot_rows(column: pa.Array) -> np.ndarray:
    """Rows that hold any byte that can begin a segment."""
    buf, offs = tx.utf8(column)
    where = np.flatnonzero(_HOT_BYTES[buf])
    return np.flatnonzero(np.diff(np.searchsorted(where, offs)))


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows, found = [], []
            for i in _hot_rows(batch.column(1)).tolist():
                got = spans(batch.column(1)[i].as_py(), field)
                rows += [i] * len(got)
                found += got
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())], ["doc_id", "start_char", "end_char", "kind"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, kind) of each piece of personal data.

    Offsets count code points. Null and empty texts give no rows; each row is
    searched for itself, so repeated rows give repeated results and a null
    doc_id stays null. An empty table gives no rows. Extra columns are not
    looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())
    plain = Placed(docs, "doc_id", "text").only().select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_find(shared), "doc_id long, start_char long, end_char long, kind string")


def redact(text: str, field: Field) -> str:
    out, done = [], 0
    for a, b, kind in spans(text, field):
        out += [text[done:a], f"[{kind}]"]
        done = b
    return "".join([*out, text[done:]])


def _redact(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = batch.column(text_at)
            hot = _hot_rows(texts)
            if len(hot):
                new = texts.to_pylist()
                for i in hot.tolist():
                    new[i] = redact(new[i], field)
                columns = list(batch.columns)
                columns[text_at] = pa.array(new, texts.type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return run


def redact_pii(docs: DataFrame) -> DataFrame:
    """The documents with each piece of personal data replaced by its kind in brackets; ``n_chars`` follows the text where there is one.

    Null texts stay null; no row is dropped.
    """
    from tidewater.llm.substring import with_length

    p = Placed(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model())
    done = p.df.mapInArrow(_redact(shared, p.private.index(p["text"])), p.df.schema)
    return p.restore(with_length(done, p))
