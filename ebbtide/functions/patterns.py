r"""Regular expressions that mean in Java what they mean in the pages' own rules: ASCII word boundaries, Unicode white space."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the no-break ones included, for use inside a character class.
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: One character of them; the rare ones are looked at only beyond Latin letters, since most characters are none.
_SPACE = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def java(pattern: str) -> str:
    r"""The pattern with `\b` at ASCII words only and `\s`, `\S` over all white space."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(_EDGE)
        elif two == r"\s":
            out.append(SPACES if inside else _SPACE)
        elif two == r"\S":
            out.append(f"[^{SPACES}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def matches(text: Column, pattern: str, marks: tuple[str, ...] = ()) -> Column:
    """Whether the pattern is found. marks: one of them is in every match; a text that holds none isn't searched."""
    found = lambda t: t.rlike(java(pattern))
    return let(text, lambda t: reduce(or_, (t.contains(m) for m in marks)) & found(t)) if marks else found(text)


def replaced(text: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(text, java(pattern), by)


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(replaced(text, r"\s+"))


def first_that(text: Column, rules, otherwise: Column | None = None) -> Column:
    """The value of the first (pattern, value) that is found in the text; marks of the pattern may follow."""
    chain = None
    for pattern, value, *marks in rules:
        value, found = value if isinstance(value, Column) else F.lit(value), matches(text, pattern, tuple(marks))
        chain = F.when(found, value) if chain is None else chain.when(found, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
