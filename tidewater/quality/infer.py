"""Semantic types guessed from a profile's samples, and a contract made of them."""

from __future__ import annotations

import ipaddress
import re
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from tidewater.contract import codes
from tidewater.contract.schema import Field, Schema
from tidewater.quality.profile import DATE, EMAIL, PHONE, URL, DataQualityReport, profile

AMBIGUOUS = 0.15
LEAST = 0.6


@dataclass(frozen=True)
class ColumnInference:
    column: str
    inferred_type: str
    confidence: float
    nullable: bool
    ambiguous: bool = False
    candidates: dict[str, float] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class InferredSchema:
    columns: dict[str, ColumnInference]

    def to_dict(self) -> dict:
        return {"columns": {n: c.to_dict() for n, c in self.columns.items()}}

    def to_schema(self) -> Schema:
        """A contract: semantic types where they are sure, else plain ones."""
        return Schema({n: _field(c) for n, c in self.columns.items()})


_SEMANTIC = {"email": "email", "url": "url", "phone": "phone", "uuid": "uuid", "ip_address": "ip_address", "date": "date", "country_code": "country_code", "currency_code": "currency_code"}


def _field(c: ColumnInference) -> Field:
    kind = c.inferred_type
    if kind in ("int64", "float64", "bool", "datetime"):
        return Field(dtype=kind, nullable=c.nullable)
    return Field(dtype="string", nullable=c.nullable, semantic=_SEMANTIC.get(kind) if not c.ambiguous else None)


def _parses(f):
    def ok(v: str) -> bool:
        try:
            f(v)
        except ValueError:
            return False
        return True

    return ok


_TESTS: dict[str, Any] = {
    "email": re.compile(EMAIL).match,
    "url": re.compile(URL).match,
    "phone": lambda v: re.match(PHONE, v) and sum(ch.isdigit() for ch in v) >= 7 and not v.isdigit(),
    "uuid": _parses(uuid.UUID),
    "ip_address": _parses(ipaddress.ip_address),
    "date": re.compile(r"^\d{4}-\d{2}-\d{2}$").match,
    "datetime": lambda v: re.match(DATE, v) and len(v) > 10,
    "country_code": codes.COUNTRIES.__contains__,
    "currency_code": codes.CURRENCIES.__contains__,
    "bool": lambda v: v.lower() in ("true", "false", "yes", "no"),
    "int64": re.compile(r"^[+-]?(?:0|[1-9]\d*)$").match,
    "float64": re.compile(r"^[+-]?(?:\d+\.\d*|\.\d+|\d+[eE][+-]?\d+)$").match,
}


def infer_schema(frame) -> InferredSchema:
    """The likeliest type of each column by its sample values; ties go to the first by name."""
    report = frame if isinstance(frame, DataQualityReport) else profile(frame)
    out = {}
    for n, c in report.columns.items():
        nullable = c.null_count > 0
        if c.dtype != "string":
            out[n] = ColumnInference(n, c.dtype, 1.0, nullable, False, {c.dtype: 1.0})
            continue
        values = [str(v).strip() for v in c.sample_values if str(v).strip()]
        scores = {k: round(sum(bool(t(v)) for v in values) / len(values), 6) for k, t in _TESTS.items()} if values else {}
        good = sorted(((k, s) for k, s in scores.items() if s >= LEAST), key=lambda x: (-x[1], x[0]))
        if not good:
            kind = "categorical" if c.semantic_type == "categorical" else "string"
            out[n] = ColumnInference(n, kind, 1.0 - max(scores.values(), default=0.0), nullable, False, {k: s for k, s in scores.items() if s})
            continue
        close = len(good) > 1 and good[0][1] - good[1][1] <= AMBIGUOUS
        out[n] = ColumnInference(n, good[0][0], good[0][1], nullable, close, dict(good))
    return InferredSchema(out)
