"""Number parsing, printing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import trim

# the usual case: at most 200 whole digits and a two-digit exponent, so every match is a finite double
DECIMAL_TEXT = r"^[+-]?(\d{1,200}(\.\d*)?|\.\d+)([eE][+-]?0*\d{1,2})?$"
ANY_DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# from here on every double is a whole number, and from 2^46 on neighbours are more than 0.01 apart
WHOLE_FROM = float(1 << 52)
CENTS_BELOW = float(1 << 46)


def parse_number(c: Column) -> Column:
    """F-04: text to double; the first comma is a decimal point; anything else is null.

    Turning every comma into a dot gives the same result: a text with two of them
    is no number either way.  The pattern is tested first because a failing cast costs
    an exception per cell, and blank cells are common.
    """
    dotted = trim(F.translate(c, ",", "."))
    number = dotted.try_cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    return F.when(dotted.rlike(DECIMAL_TEXT), number).when(dotted.rlike(ANY_DECIMAL_TEXT), finite)


def js_number(name: str) -> Column:
    """F-08: shortest text of the double column ``name``, ``10`` rather than ``10.0``.

    Java prints no exponent from 1e-3 up to 1e7, where only a ``.0`` has to go.
    Other values take their digits from a decimal, or keep an exponent from 1e21 up
    and below 1e-6.
    """
    text = f"cast({name} + 0D as string)"
    exponent = f"regexp_replace(regexp_replace({text}, '(\\\\.0)?E-', 'e-'), '(\\\\.0)?E', 'e+')"

    def plain(scale: int) -> str:
        return f"regexp_replace(cast(try_cast({text} as decimal(38,{scale})) as string), '\\\\.?0+$', '')"

    return F.expr(
        f"""case
            when not contains({text}, 'E') then
                if(endswith({text}, '.0'), substring_index({text}, '.', 1), {text})
            when {text} rlike 'E-([7-9]|[1-9][0-9])' then {exponent}
            else coalesce({plain(30)}, {plain(17)}, {exponent})
        end"""
    )


def js_text(value: float) -> str:
    """The same text for a number known when the plan is built."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def round_half_up(c: Column) -> Column:
    """Nearest whole number, halves toward plus infinity; doubles of 2^52 and more are whole already.

    Doubling is exact, so a value just below a half stays below it.
    """
    return F.when(F.abs(c) >= WHOLE_FROM, c).otherwise(F.ceil(F.floor(c * 2.0) / 2.0).cast("double"))


def round_base(amount: Column, currency: Column) -> Column:
    """F-13: whole pesos for CLP, one decimal for every other base currency."""
    return F.when(F.upper(currency) == "CLP", round_half_up(amount)).otherwise(
        round_half_up(amount * 10.0) / 10.0
    )


def to_fixed2(c: Column) -> Column:
    """F-36: two decimals, rounded on the exact binary value.

    ``c * 100`` is split into a rounded product and its exact error (Dekker), so a
    value just below a half is not pushed over it by the multiplication.
    """
    x = F.abs(c)
    big = x * 134217729.0
    high = big - (big - x)
    low = x - high
    product = x * 100.0
    error = (high * 100.0 - product) + low * 100.0
    whole = F.floor(product).cast("double")
    part = (product - whole) + error
    cents = whole + F.when(part >= 0.5, F.lit(1.0)).when(part < -0.5, F.lit(-1.0)).otherwise(F.lit(0.0))
    return F.when(x >= CENTS_BELOW, c).otherwise(F.signum(c) * cents / 100.0)
