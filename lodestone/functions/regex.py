"""Regular expressions of report filters and the find bar.

Patterns are extended POSIX ones with \\d, \\s, \\w and \\b besides. They are
spelled anew for Java, which decides whether a text matches, and for the
``regex`` module, which finds leftmost-longest matches. Patterns are
case-sensitive if they hold any upper-case ASCII letter (so \\B, \\W, \\D and \\S
are too), else they fold case over all of Unicode. ``^`` and ``$`` work at every
line, ``.`` matches no line feed, groups capture nothing. What the syntax lacks
(``(?``, references back) is invalid, as are classes of unknown names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = "0-9A-Za-z_"
SPACE = "\\t\\n\\f\\r "
# The named classes of POSIX, over ASCII.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7f", "blank": "\\t ", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0b\\f\\r ", "upper": "A-Z", "word": WORD, "xdigit": "0-9A-Fa-f",
}
_BOUND = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
_NO_BOUND = f"(?:(?<![{WORD}])(?![{WORD}])|(?<=[{WORD}])(?=[{WORD}]))"
ESCAPES = {"d": "[0-9]", "D": "[^0-9]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "w": f"[{WORD}]", "W": f"[^{WORD}]", "b": _BOUND, "B": _NO_BOUND, "n": "\\n", "t": "\\t", "r": "\\r", "f": "\\f", "v": "\\x0b", "a": "\\x07"}
_NAMED = re.compile(r"\[:(\^?)(\w+):\]")
_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    """A bracket expression that begins at a place, spelled for both, and where it ends."""
    i = at + 1
    negated = pattern.startswith("^", i)
    i += negated
    inside, outside, first = [], [], True  # members, and members that are classes left out
    while True:
        if i >= len(pattern):
            raise ValueError(f"missing ]: {pattern}")
        c = pattern[i]
        if c == "]" and not first:
            break
        first = False
        named = _NAMED.match(pattern, i)
        if named:
            if named[2] not in CLASSES:
                raise ValueError(f"unknown class: {named[0]}")
            (outside if named[1] else inside).append(CLASSES[named[2]])
            i = named.end()
            continue
        if c == "\\":
            if i + 1 >= len(pattern):
                raise ValueError(f"trailing backslash: {pattern}")
            e = pattern[i + 1]
            i += 2
            if e in "dsw":
                inside.append(ESCAPES[e][1:-1])
            elif e in "DSW":
                outside.append(ESCAPES[e][2:-1])
            elif e in ESCAPES and e not in "bB":
                inside.append(ESCAPES[e])
            elif e.isalnum():
                raise ValueError(f"unknown escape: {pattern}")
            else:
                inside.append("\\" + e)
            continue
        inside.append("-" if c == "-" and inside and inside[-1] != "-" and not pattern.startswith("]", i + 1) else c if c.isalnum() or c.isspace() or ord(c) > 127 else "\\" + c)
        i += 1
    parts = [f"[{''.join(inside)}]"] * bool(inside) + [f"[^{x}]" for x in outside]
    any_of = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return (f"(?!{any_of})(?s:.)" if len(parts) > 1 else f"[^{any_of[1:]}" if not outside else f"[{outside[0]}]") if negated else any_of, i + 1


def translated(pattern: str) -> str:
    """The pattern as Java and the regex module read it; ValueError where it isn't valid."""
    out: list[str] = []
    groups: list[int] = []  # where open groups begin
    atom: int | None = None  # where the last atom begins
    i = 0
    while i < len(pattern):
        c = pattern[i]
        count = _COUNT.match(pattern, i)
        if c in "*+?" or count:
            if atom is None:
                raise ValueError(f"nothing to repeat: {pattern}")
            op = count[0] if count else c
            out[atom:] = [f"(?:{''.join(out[atom:])}){op}"]
            i += len(op)
            continue
        start = len(out)
        if c == "(":
            if pattern.startswith("?", i + 1):
                raise ValueError(f"no such group: {pattern}")
            groups.append(start)
            out.append("(?:")
            atom = None
        elif c == ")":
            if not groups:
                raise ValueError(f"missing (: {pattern}")
            out.append(")")
            atom = groups.pop()
        elif c == "|":
            out.append("|")
            atom = None
        elif c == "[":
            text, end = _bracket(pattern, i)
            out.append(text)
            atom, i = start, end
            continue
        elif c == "\\":
            e = pattern[i + 1 : i + 2]
            if not e or e.isalnum() and e not in ESCAPES:
                raise ValueError(f"unknown escape: {pattern}")
            out.append(ESCAPES.get(e, "\\" + e))
            atom = start
            i += 1
        else:
            out.append({"^": "(?<![^\\n])", "$": "(?![^\\n])", ".": "[^\\n]", "{": "\\{", "}": "\\}", "]": "\\]", "#": "\\#", "&": "\\&", "~": "\\~"}.get(c, c))
            atom = start
        i += 1
    if groups:
        raise ValueError(f"missing ): {pattern}")
    return "".join(out)


def folds_case(pattern: str) -> bool:
    return not re.search("[A-Z]", pattern)


def java_pattern(pattern: str) -> str:
    """The pattern for Java, with smart case."""
    return ("(?iu)" if folds_case(pattern) else "") + translated(pattern)


def longest_pattern(pattern: str) -> object:
    """The pattern compiled for leftmost-longest search."""
    import regex

    return regex.compile(translated(pattern), regex.POSIX | (regex.IGNORECASE if folds_case(pattern) else 0))


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern is valid; the empty one counts as such."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except Exception:  # ValueError, or a Java exception by way of the gateway
        return False
    return True


def report_filter(column: Column, pattern: str) -> Column:
    """Unanchored search; an empty pattern matches every row."""
    return F.lit(True) if not pattern else column.rlike(java_pattern(pattern))


def next_filter(spark: SparkSession, typed: str, in_force: str) -> str:
    """The filter after typing: an invalid pattern leaves the former one in force."""
    return typed if valid(spark, typed) else in_force
