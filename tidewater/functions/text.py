"""Text expressions that Spark evaluates without Python."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

C_SPACE = r"[ \t\n\x0B\f\r]"
#: White space as Python's str.strip sees it.
U_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_U_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(c, f"^{C_SPACE}+|{C_SPACE}+$(?!\\n)", "")


def strip_unicode(c: Column) -> Column:
    """As Python's str.strip; a trim, since an expression would be tried at every character."""
    return F.btrim(c, F.lit(_U_SPACES))


def lower(c: Column) -> Column:
    """ASCII letters only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def upper(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def title(c: Column) -> Column:
    """ASCII title case; words begin at the start and after white space, ``-``, ``_``, ``.`` and ``/``."""
    parts = F.split(F.regexp_replace(lower(c), r"([ \t\n\x0B\f\r\-_./])", "$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda w: F.concat(upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), "")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{U_SPACE}+", " "))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")


def python_text(c: Column, kind: str) -> Column:
    """A value as Python prints it: ``True``/``False`` and the 17 significant digits of a float."""
    if kind == "bool":
        return F.when(c, "True").when(~c, "False")
    if kind == "float64":
        whole = (F.abs(c) < 1e15) & (c == F.floor(c))
        plain = F.format_string("%.1f", c)
        return F.when(c.isNull(), None).when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).when(whole, plain).otherwise(c.cast("string"))
    return c.cast("string")
