r"""Amounts: reading French ones from text, writing them, equivalents by month. All amounts are whole cents.

`amounts()` gives structs (cents, direction, text, at, size), in order; `at` counts characters from 0 in the mended text.
A null text has no amounts (null array).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.patterns import java, let, replaced, squeezed

_GAP = r"[ \u00A0\u202F]"
# The form of an amount, and of a token in which letters stand for digits.
WHOLE = rf"([+\-−–]{_GAP}?)?(\d{{1,3}}(?:(?:{_GAP}|\.)\d{{3}})+|\d+)"
AMOUNT = java(rf"{WHOLE}(?:[,.](\d{{2}}))?(?![\d/])(?:{_GAP}?(€|EUR\b|E\b))?")
ACCEPTED = java(rf"^{WHOLE}(?:[,.]\d{{2}}(?![\d/])(?:{_GAP}?(?:€|EUR\b|E\b))?|(?![\d/]){_GAP}?(?:€|EUR\b))$")
MISREAD = r"(?<!\p{L})[+\-−–]?[\dOoIl]+[,.][\dOoIl]{2}(?![\p{L}\d])"
#: What every accepted amount holds: decimals, or a currency after a digit. Texts without it aren't cut into pieces.
PRICED = rf"\d(?:[,.]\d{{2}}|{_GAP}?(?:€|EUR))"
AMOUNTS = "array<struct<cents:bigint,direction:string,text:string,at:int,size:int>>"
# Payments of a year, by period.
PER_YEAR = {"weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}


def _pieces(text: Column, pattern: str, others: str) -> Column:
    """The text cut into whole matches and what lies between them (in runs that cannot begin a match, or single characters)."""
    return F.regexp_extract_all(text, F.lit(rf"{pattern}|{others}+|(?s:.)"), F.lit(0))


def fix_digits(text: Column) -> Column:
    """O and l, I as 0 and 1 in tokens that look like an amount and hold a digit."""
    parts = _pieces(text, MISREAD, r"[^+\-−–\dOoIl]")
    mended = F.transform(parts, lambda p: F.when((F.length(p) > 3) & p.rlike(r"\d") & p.rlike(r"^[+\-−–]?[\dOoIl]+[,.][\dOoIl]{2}$"), F.translate(p, "OoIl", "0011")).otherwise(p))
    return F.when(text.rlike(r"[OoIl]") & text.rlike(r"\d") & text.rlike(MISREAD), F.array_join(mended, "")).otherwise(text)


def _priced(text: Column, found: Callable[[Column], Column], otherwise: Callable[[Column], Column]) -> Column:
    """found(pieces) of the mended text, or otherwise(mended text) if it can't hold an amount; null for a null text."""
    pieces = lambda t: let(_pieces(t, AMOUNT, r"[^\d+\-−–]"), found)
    return let(fix_digits(text), lambda t: F.when(t.rlike(PRICED), pieces(t)).when(t.isNotNull(), otherwise(t)))


def _accepted(piece: Column) -> Column:
    """A whole match that has decimals or a currency (`E` only after decimals)."""
    return piece.rlike(ACCEPTED)


def _parsed(piece: Column, *more: Column) -> Column:
    """cents, direction and text of a whole match, which begins with its sign or a digit and doesn't end in a blank.

    Groups of its whole part have three digits, so a point or comma before the last two is that of decimals.
    """
    direction = F.when(piece.startswith("+"), "credit").when(_signed(piece), "debit").otherwise("unknown")
    number = F.translate(piece, "+-−– \u00a0\u202f€EUR", "")

    def cents(number: Column) -> Column:
        digits = F.translate(number, ",.", "").try_cast("bigint")
        return F.when((F.length(number) > 3) & F.substring(number, -3, 1).isin(",", "."), digits).otherwise(F.try_multiply(digits, F.lit(100).cast("bigint")))

    return F.struct(let(number, cents).alias("cents"), direction.alias("direction"), piece.alias("text"), *more)


def _signed(piece: Column) -> Column:
    return piece.rlike(r"^[+\-−–]")


def _kept(parts: Column) -> Column:
    """The accepted pieces with their places."""
    return F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: _accepted(x["p"]))


def _all_parsed(parts: Column, kept: Column) -> Column:
    return F.transform(kept, lambda x: _parsed(x["p"], F.length(F.array_join(F.slice(parts, F.lit(1), x["i"]), "")).alias("at"), F.length(x["p"]).alias("size")))


def amounts(text: Column) -> Column:
    return _priced(text, lambda parts: _all_parsed(parts, _kept(parts)), lambda _: F.array().cast(AMOUNTS))


def last_amount(text: Column) -> Column:
    """The right-most amount's struct, or null."""
    last = lambda parts: _all_parsed(parts, F.slice(F.reverse(_kept(parts)), 1, 1))
    return F.get(_priced(text, last, lambda _: F.lit(None).cast(AMOUNTS)), F.lit(0))


def has_amount(text: Column) -> Column:
    return _priced(text, lambda parts: F.exists(parts, _accepted), lambda _: F.lit(False))


def reading(text: Column) -> Column:
    """struct(n, signed, last, rest) from one cut of the text: how many amounts, whether one has a sign, the right-most one (cents, direction, text), the text without them."""
    kind = "struct<cents:bigint,direction:string,text:string>"

    def found(parts: Column) -> Column:
        def told(tagged: Column) -> Column:
            held = lambda wanted: F.transform(F.filter(tagged, lambda x: x["ok"] == wanted), lambda x: x["p"])
            seen = lambda kept: F.struct(
                F.size(kept).alias("n"), F.exists(kept, _signed).alias("signed"), F.get(F.transform(F.slice(F.reverse(kept), 1, 1), lambda p: _parsed(p)), F.lit(0)).alias("last"), squeezed(F.array_join(held(False), "")).alias("rest")
            )
            return let(held(True), seen)

        return let(F.transform(parts, lambda p: F.struct(p.alias("p"), _accepted(p).alias("ok"))), told)

    return _priced(text, found, lambda t: F.struct(F.lit(0).alias("n"), F.lit(False).alias("signed"), F.lit(None).cast(kind).alias("last"), squeezed(t).alias("rest")))


def without_amounts(text: Column) -> Column:
    return squeezed(_priced(text, lambda parts: F.array_join(F.filter(parts, lambda p: ~_accepted(p)), ""), lambda t: t))


def format_euros(cents: Column) -> Column:
    """`1 234,56 €` with the narrow and the wide no-break space."""
    size = F.abs(cents)
    whole = F.regexp_replace(F.floor(size / 100).cast("string"), r"(?<=\d)(?=(\d{3})+$)", "\u202f")
    sign = F.when(cents < 0, "-").otherwise("")
    return F.concat(sign, whole, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"), F.lit("\u00a0€"))


def format_signed_euros(cents: Column) -> Column:
    return F.concat(F.when(cents < 0, "−").otherwise("+"), format_euros(F.abs(cents)))


def yearly_from_monthly(cents: Column) -> Column:
    return cents * 12


def parse_euro_input(text: Column) -> Column:
    """Cents of what a user typed; null if it is no amount."""
    clean = F.regexp_replace(F.regexp_replace(text, java(r"[\s€]"), ""), "^([^,]*),", "$1.")
    whole, part = F.regexp_extract(clean, r"^(\d+)(?:\.(\d{1,2}))?$", 1), F.regexp_extract(clean, r"^(\d+)(?:\.(\d{1,2}))?$", 2)
    return F.when(whole != "", whole.try_cast("bigint") * 100 + F.rpad(part, 2, "0").cast("bigint"))


def cents_to_input(cents: Column) -> Column:
    size = F.abs(cents)
    text = F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(""))


def is_stable(least: Column, most: Column) -> Column:
    """Within 1 euro or 10 % of the least; true without amounts."""
    return F.coalesce(most - least <= F.greatest(F.lit(100.0), least * F.lit(0.1)), F.lit(True))


def monthly_equivalent(cents: Column, period: Column) -> Column:
    """Rounded half up; null for an unknown period."""
    chain = None
    for name, times in PER_YEAR.items():
        value = cents if times == 12 else F.floor((2 * cents * times + 12) / 24)
        chain = F.when(period == name, value) if chain is None else chain.when(period == name, value)
    return chain.cast("bigint")
