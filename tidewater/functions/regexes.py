"""Python regular expressions on the JVM."""

from __future__ import annotations

import re


def unsafe(pattern: str) -> bool:
    """A quantified group that holds an unbounded quantifier, which can backtrack exponentially."""
    stack, escaped, in_set, last = [], False, False, False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if escaped:
            escaped = False
            last = False
        elif ch == "\\":
            escaped = True
        elif in_set:
            in_set = ch != "]"
        elif ch == "[":
            in_set, last = True, False
        elif ch == "(":
            stack.append(False)
            last = False
        elif ch == ")":
            last = stack.pop() if stack else False
            if stack and last:
                stack[-1] = True
            i += 1
            rest = pattern[i : i + 1]
            if last and (rest in ("*", "+") or re.match(r"\{\d+,\}", pattern[i:])):
                return True
            continue
        elif ch in "*+" or re.match(r"\{\d+,\}", pattern[i:]):
            if stack:
                stack[-1] = True
        i += 1
    return False


def check(pattern: str, operation: str) -> re.Pattern:
    """The compiled pattern; refused where it doesn't compile or may take exponential time."""
    if not isinstance(pattern, str):
        raise TypeError(f"{operation}: the pattern must be a string")
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise ValueError(f"{operation}: invalid pattern: {error}") from error
    if unsafe(pattern):
        raise ValueError(f"{operation}: the pattern nests unbounded quantifiers")
    return compiled


_UNSUPPORTED = re.compile(r"\(\?P=|\(\?\(|\(\?[aLu]|\\N\{|\(\?P>")


def to_java(pattern: str) -> str | None:
    """The pattern in Java's dialect with Unicode classes, or None where it has no such form."""
    if _UNSUPPORTED.search(pattern):
        return None
    out = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9_]*)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    # an opening bracket inside a set means something else to Java
    fixed, in_set, i = [], False, 0
    while i < len(out):
        if out[i] == "\\":
            fixed.append(out[i : i + 2])
            i += 2
            continue
        if in_set and (out[i] == "[" or out[i : i + 2] == "&&"):
            fixed.append("\\")
        elif out[i] == "[":
            in_set = True
            if out[i + 1 : i + 2] == "]" or out[i + 1 : i + 3] == "^]":
                k = 2 if out[i + 1] == "]" else 3
                fixed.append(out[i : i + k - 1] + "\\]")
                i += k
                continue
        elif out[i] == "]":
            in_set = False
        fixed.append(out[i])
        i += 1
    return "(?U)" + "".join(fixed)


def full(pattern: str) -> str | None:
    """A Java pattern that holds only where all of the text matches."""
    java = to_java(pattern)
    return None if java is None else rf"{java[:4]}\A(?:{java[4:]})\z"
