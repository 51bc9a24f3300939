"""Contracts: fields, schemas, their builders and their forms on disk."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tidewater.contract import codes
from tidewater.functions import regexes

TYPES = ("string", "int64", "float64", "bool", "datetime", None)
SEVERITIES = ("error", "warning", "info")
_validators: dict[str, Callable[[Any], Any]] = {}


def register_validator(name: str, fn: Callable[[Any], Any], *, overwrite: bool = False) -> None:
    """Adds a function of a value that says whether it is valid, for ``Custom(name)``."""
    if not isinstance(name, str) or not name:
        raise ValueError("register_validator: the name must be a string with text")
    if not callable(fn):
        raise TypeError("register_validator: the validator must be callable")
    if name in _validators and not overwrite:
        raise ValueError(f"register_validator: {name!r} is registered")
    _validators[name] = fn


def validator(name: str) -> Callable[[Any], Any] | None:
    return _validators.get(name)


@dataclass(frozen=True)
class Field:
    """Rules for one column; bounds are inclusive."""

    dtype: str | None = None
    nullable: bool = True
    min: Any = None
    max: Any = None
    pattern: str | None = None
    semantic: str | None = None
    allowed: Any = None
    case_sensitive: bool = True
    unique: bool = False
    min_length: int | None = None
    max_length: int | None = None
    format: str | None = None
    required_if: tuple[str, Any] | None = None
    severity: str = "error"
    custom: str | None = None

    def __post_init__(self) -> None:
        if self.dtype not in TYPES:
            raise ValueError(f"a field's dtype must be one of {', '.join(map(str, TYPES))}, not {self.dtype!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {', '.join(SEVERITIES)}")
        if self.pattern is not None:
            regexes.check(self.pattern, "pattern")
        if self.allowed is not None:
            object.__setattr__(self, "allowed", frozenset(self.allowed))
        if self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError("a field's min exceeds its max")
        for n in (self.min_length, self.max_length):
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
                raise ValueError("lengths must be integers that aren't negative")
        if self.min_length is not None and self.max_length is not None and self.min_length > self.max_length:
            raise ValueError("min_length exceeds max_length")
        if self.required_if is not None:
            if len(tuple(self.required_if)) != 2 or not isinstance(self.required_if[0], str):
                raise ValueError("required_if must be (column, value)")
            object.__setattr__(self, "required_if", tuple(self.required_if))

    def to_dict(self) -> dict[str, Any]:
        """The settings that differ from the defaults."""
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if v != f.default:
                out[f.name] = sorted(v, key=str) if isinstance(v, frozenset) else list(v) if isinstance(v, tuple) else v.isoformat() if isinstance(v, dt.date) else v
        return out

    @classmethod
    def from_dict(cls, value: dict) -> Field:
        unknown = set(value) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings of a field: {', '.join(sorted(unknown))}")
        value = dict(value)
        if value.get("required_if") is not None:
            value["required_if"] = tuple(value["required_if"])
        return cls(**value)


@dataclass(frozen=True)
class Schema:
    """Fields by column; ``strict`` refuses other columns, ``unique`` names a composite key, ``rules`` take the frame and return a frame of issues."""

    fields: dict[str, Field] = field(default_factory=dict)
    strict: bool = False
    unique: Any = None
    rules: Any = None

    def __post_init__(self) -> None:
        if not isinstance(self.fields, dict) or any(not isinstance(f, Field) for f in self.fields.values()):
            raise TypeError("a schema maps column names to fields")
        if self.unique is not None and (isinstance(self.unique, str) or not list(self.unique)):
            raise ValueError("unique must be a list of columns")

    def validate(self, df, max_errors: int | None = None, **options):
        from tidewater.contract.validate import validate

        return validate(df, self, max_errors, **options)

    def to_dict(self) -> dict:
        return schema_to_dict(self)

    def to_json(self) -> str:
        return json.dumps(schema_to_dict(self), indent=2, ensure_ascii=False)

    @classmethod
    def from_dict(cls, value: dict) -> Schema:
        if not isinstance(value, dict) or not isinstance(value.get("fields"), dict):
            raise ValueError("a schema needs a mapping of fields")
        return cls({n: Field.from_dict(f) for n, f in value["fields"].items()}, bool(value.get("strict", False)), value.get("unique"))

    @classmethod
    def from_json(cls, value: str) -> Schema:
        return cls.from_dict(json.loads(value))

    @classmethod
    def bootstrap_from_report(cls, report) -> Schema:
        """Types as profiled; nullable where nulls were."""
        return cls({n: Field(dtype=c.dtype if c.dtype in TYPES else "string", nullable=c.null_count > 0) for n, c in report.columns.items()})


def schema_to_dict(schema: Schema) -> dict:
    out: dict[str, Any] = {"fields": {n: f.to_dict() for n, f in schema.fields.items()}, "strict": schema.strict}
    if schema.unique:
        out["unique"] = list(schema.unique)
    if schema.rules:
        raise ValueError("a schema with rules can't be written: they are functions")
    return out


def schema_to_yaml(schema: Schema, path=None) -> str:
    import yaml

    body = yaml.safe_dump(schema_to_dict(schema), sort_keys=False, allow_unicode=True)
    if path is not None:
        from tidewater.plans.pipeline import write_whole

        write_whole(Path(path), body)
    return body


def schema_from_yaml(source) -> Schema:
    """A schema from YAML text or a file of it."""
    import yaml

    text = str(source)
    if isinstance(source, Path) or ("\n" not in text and Path(text).suffix in (".yaml", ".yml")):
        text = Path(source).read_text(encoding="utf-8")
    return Schema.from_dict(yaml.safe_load(text))


def _builder(name: str, fixed: dict[str, Any], doc: str):
    def build(**settings) -> Field:
        return Field(**{**fixed, **settings})

    build.__name__ = build.__qualname__ = name
    build.__doc__ = doc
    return build


Int64 = _builder("Int64", {"dtype": "int64"}, "Whole numbers.")
Float64 = _builder("Float64", {"dtype": "float64"}, "Decimal numbers.")
String = _builder("String", {"dtype": "string"}, "Text.")
Bool = _builder("Bool", {"dtype": "bool"}, "True and False.")
PhoneNumber = _builder("PhoneNumber", {"dtype": "string", "semantic": "phone"}, "Phone numbers.")
CountryCode = _builder("CountryCode", {"dtype": "string", "semantic": "country_code"}, "ISO 3166-1 alpha-2 codes.")
LanguageCode = _builder("LanguageCode", {"dtype": "string", "semantic": "language_code"}, "ISO 639-1 codes.")
TimeZone = _builder("TimeZone", {"dtype": "string", "semantic": "timezone"}, "IANA time zones.")
IPv4 = _builder("IPv4", {"dtype": "string", "semantic": "ipv4"}, "IPv4 addresses.")
MACAddress = _builder("MACAddress", {"dtype": "string", "semantic": "mac_address"}, "MAC addresses.")
CreditCard = _builder("CreditCard", {"dtype": "string", "semantic": "credit_card"}, "Card numbers that pass the Luhn check.")
DateTime = _builder("DateTime", {"dtype": "datetime"}, "Timestamps in text.")
Date = _builder("Date", {"dtype": "string", "semantic": "date"}, "Calendar dates as yyyy-MM-dd.")


def Email(*, validation: str = "light", **settings) -> Field:
    if validation not in ("light", "strict"):
        raise ValueError("Email: validation must be light or strict")
    return Field(dtype="string", semantic="email" + ":strict" * (validation == "strict"), **settings)


def URL(*, allowed_schemes=None, **settings) -> Field:
    return Field(dtype="string", semantic="url" if not allowed_schemes else "url:" + ",".join(sorted(s.lower() for s in allowed_schemes)), **settings)


def CurrencyCode(*, allowed=None, **settings) -> Field:
    if allowed is not None and set(map(str.upper, allowed)) - codes.CURRENCIES:
        raise ValueError("CurrencyCode: not an ISO 4217 code")
    return Field(dtype="string", semantic="currency_code", allowed=allowed, **settings)


def UUID(*, version: int | None = None, **settings) -> Field:
    if version is not None and version not in range(1, 9):
        raise ValueError("UUID: version must be within 1 and 8")
    return Field(dtype="string", semantic="uuid" if version is None else f"uuid:{version}", **settings)


def IPAddress(*, version: int | None = None, **settings) -> Field:
    if version not in (None, 4, 6):
        raise ValueError("IPAddress: version must be 4 or 6")
    return Field(dtype="string", semantic="ip_address" if version is None else f"ip_address:{version}", **settings)


def Regex(pattern: str, **settings) -> Field:
    return Field(dtype="string", pattern=pattern, **settings)


def Custom(name: str, **settings) -> Field:
    if validator(name) is None:
        raise ValueError(f"Custom: no validator {name!r} is registered")
    return Field(custom=name, **settings)


def Choice(allowed, **settings) -> Field:
    allowed = list(allowed)
    if not allowed:
        raise ValueError("Choice: nothing is allowed")
    return Field(allowed=allowed, **settings)


@dataclass(frozen=True)
class SchemaDiffEntry:
    column: str | None
    change: str
    expected: Any = None
    observed: Any = None

    def to_dict(self) -> dict:
        return {"column": self.column, "change": self.change, "expected": self.expected, "observed": self.observed}


@dataclass(frozen=True)
class SchemaDiff:
    entries: list[SchemaDiffEntry]

    @property
    def changed(self) -> bool:
        return bool(self.entries)

    @property
    def difference_count(self) -> int:
        return len(self.entries)

    def summary(self) -> dict:
        by: dict[str, int] = {}
        for e in self.entries:
            by[e.change] = by.get(e.change, 0) + 1
        return {"changed": self.changed, "difference_count": self.difference_count, "by_change": by}

    def to_dict(self) -> dict:
        return self.summary() | {"entries": [e.to_dict() for e in self.entries]}

    def to_markdown(self, output=None) -> str:
        from tidewater.quality.profile import _emit

        lines = ["| column | change | expected | observed |", "|---|---|---|---|", *[f"| {e.column or '-'} | {e.change} | {e.expected} | {e.observed} |" for e in self.entries]]
        return _emit("\n".join(lines) + "\n", output)


def diff_schema(expected: Schema, observed: Schema) -> SchemaDiff:
    """Fields missing, extra or with other settings, and changes of strict, unique and rules."""
    out = [SchemaDiffEntry(n, "missing_field", f.to_dict()) for n, f in expected.fields.items() if n not in observed.fields]
    out += [SchemaDiffEntry(n, "extra_field", None, f.to_dict()) for n, f in observed.fields.items() if n not in expected.fields]
    for n, f in expected.fields.items():
        if n in observed.fields:
            g = observed.fields[n]
            out += [SchemaDiffEntry(n, f"changed_{x.name}", getattr(f, x.name), getattr(g, x.name)) for x in fields(Field) if getattr(f, x.name) != getattr(g, x.name)]
    for what in ("strict", "unique"):
        a, b = getattr(expected, what), getattr(observed, what)
        if (list(a) if what == "unique" and a else a or False) != (list(b) if what == "unique" and b else b or False):
            out.append(SchemaDiffEntry(None, f"changed_{what}", a, b))
    if len(expected.rules or ()) != len(observed.rules or ()):
        out.append(SchemaDiffEntry(None, "changed_rules", len(expected.rules or ()), len(observed.rules or ())))
    return SchemaDiff(out)
