"""Scalar Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falsy_default(x: Column, default: Column) -> Column:
    """x, or default where x is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), default)


def number_or_null(x: Column) -> Column:
    """NaN as null: comparisons with a missing number are false, not above everything."""
    return F.nanvl(x, F.lit(None).cast("double"))


def pad_code(code: Column, width: int = 6) -> Column:
    """Zeros on the left up to the width; longer codes stay whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def scale_change(x: Column, scale: str = "guess") -> Column:
    """A change in percent. scale: 'guess' takes values below 1 as fractions, 'fraction' all, 'percent' none."""
    if scale == "percent":
        return x
    return x * 100 if scale == "fraction" else F.when(F.abs(x) < 1, x * 100).otherwise(x)


def parse_two_date_formats(text: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd as a date, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")


def elapsed_label(candle_date: Column, today: Column, candle_class: Column) -> tuple[Column, Column]:
    """Days since the candle (0 if unknown) and the row's label."""
    days = F.coalesce(F.datediff(today, candle_date), F.lit(0))
    text = F.when(days <= 0, "당일").when(days == 1, "1일차").otherwise(F.format_string("%d일차", days))
    return days, F.concat(F.coalesce(candle_class, F.lit("")), F.lit(" 기준봉 "), text)


def parse_year(text: Column) -> Column:
    """The first 20dd of a text as a number, else null."""
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit("")).try_cast("int")


def parse_amount(text: Column) -> Column:
    """A number with thousands separators; blank, '-', 'N/A' and anything else are null."""
    bare = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(~bare.isin("", "-", "N/A"), bare.try_cast("double"))


def to_base_unit(amount: Column, unit: float = 1e8) -> Column:
    """Hundred millions as single units, truncated."""
    return (amount * unit).cast("long")


def code_seed(code: Column, close: Column) -> Column:
    """Sum of the code's characters plus the whole close modulo 997."""
    chars = F.transform(F.split(code, ""), lambda c: F.ascii(c))
    return F.aggregate(chars, F.lit(0), lambda a, b: a + b).cast("long") + F.pmod(close.cast("long"), F.lit(997))


def format_won(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def signed_pct(x: Column, digits: int = 2) -> Column:
    """With its sign; ties round to the even digit."""
    return F.format_string(f"%+.{digits}f%%", F.bround(x, digits))


def encode_b64(text: Column) -> Column:
    """Base64 of UTF-8 on one line; empty for null and empty texts."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", ""))


def touch_list(price: Column, lines: dict[str, Column], tolerance: float) -> Column:
    """Names of the lines within a relative tolerance of the price, in the given order."""
    rows = F.array(*(F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in lines.items()))
    near = F.filter(rows, lambda r: F.coalesce((r["value"] > 0) & (F.abs(price - r["value"]) <= tolerance * r["value"]), F.lit(False)))
    return F.transform(near, lambda r: r["name"])


def pick_template(pool: list[str], seed: Column, step: int = 1) -> Column:
    """An entry of a pool of texts, by seed div step."""
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(F.floor(seed / step), F.lit(len(pool))) + 1).cast("int"))
