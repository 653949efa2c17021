"""Text primitives that every review operator shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space that str.strip() removes, as a regex class.
SPACE = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Characters whose case folding holds ASCII letters and differs from lower().
FOLDS = {
    "ß": "ss", "ẞ": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
TOKEN = "[A-Za-z0-9]+"
NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?$"
ODD_NUMBER = r"^(?i)[+-]?(?:nan|inf|infinity)$"


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def float_text(c: Column) -> Column:
    """Doubles as Python prints them: 10000000.0 and 1e-05, not 1.0E7."""
    text = c.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1)
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    digits = F.regexp_replace(power, "-", "")
    science = F.concat(
        F.regexp_replace(F.regexp_replace(text, r"E.*$", ""), r"\.0$", ""), F.lit("e"), sign, F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), "0")
    )
    small = F.abs(c)
    odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(
        odd, F.when(~text.contains("E"), text).when((small >= 1e-4) & (small < 1e16), plain).otherwise(science)
    )


def as_text(df: DataFrame, name: str) -> Column:
    """The column's value as text; null becomes empty.

    Arrays, maps and structs hold no one value and raise ValueError.
    """
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        raise ValueError(f"Column {name} is nested; convert it to text first.")
    if isinstance(kind, T.DoubleType | T.FloatType):
        c = F.when(F.isnan(c), "").otherwise(float_text(c.cast("double")))
    elif isinstance(kind, T.BooleanType):
        c = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        c = F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.coalesce(c.cast("string"), F.lit(""))


def text(df: DataFrame, name: str) -> Column:
    """The column's value as stripped text."""
    return strip(as_text(df, name))


def fold(c: Column) -> Column:
    c = F.lower(c)
    for letter, to in FOLDS.items():
        c = F.replace(c, F.lit(letter), F.lit(to))
    return c


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"))


def normalized(c: Column, how: str) -> Column:
    """``basic``: folded ASCII tokens with single blanks; ``none``: stripped."""
    if how == "none":
        return strip(c)
    if how == "basic":
        return F.array_join(tokens(fold(c)), " ")
    raise ValueError(f"Unknown normalization: {how}")


def float_of(c: Column) -> Column:
    """What Python's float() accepts, as a double; else null."""
    c = strip(c)
    odd = F.lower(F.regexp_replace(c, r"^\+", ""))
    odd = F.when(odd.isin("nan", "-nan"), F.lit(float("nan"))).when(odd.isin("inf", "infinity"), F.lit(float("inf"))).when(odd.isin("-inf", "-infinity"), F.lit(float("-inf")))
    return F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double")).when(c.rlike(ODD_NUMBER), odd)


def number_of(c: Column) -> Column:
    """A number as people write it: currency signs, commas, percent, (negative)."""
    c = strip(c)
    inside = F.regexp_extract(c, r"^\((.*)\)$", 1)
    wrapped = c.rlike(r"(?s)^\(.*\)$")
    value = float_of(F.regexp_replace(F.when(wrapped, inside).otherwise(c), "[$€£,%]", ""))
    return F.when(wrapped, -value).otherwise(value)


def marked_currency(c: Column) -> Column:
    return c.rlike("[$€£,]")


def moment_of(c: Column) -> Column:
    """A date or time in one of the accepted forms, as a UTC timestamp without zone."""
    c = strip(c)

    def at(pattern: str, fmt: str) -> Column:
        return F.when(c.rlike(pattern), F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))

    year = F.regexp_extract(c, r"/(\d\d)$", 1).try_cast("int")
    century = F.when(year >= 69, "19").otherwise("20")
    short = F.concat(F.regexp_replace(c, r"\d\d$", ""), century, F.regexp_extract(c, r"(\d\d)$", 1))
    iso = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d(?::\d\d(?::\d\d(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d\d(?::?\d\d)?)?)?$"
    full = F.regexp_replace(F.regexp_replace(c, ",", "."), r"([T ]\d\d)(Z|[+-]|$)", "$1:00$2")
    zoned = F.when(full.rlike(r"(?:Z|[T ].*[+-]\d\d(?::?\d\d)?)$"), full.try_cast("timestamp").cast("timestamp_ntz"))
    week = r"^(\d{4})-?W(\d\d)(?:-?(\d))?$"
    monday = F.date_sub(F.make_date(F.regexp_extract(c, week, 1).try_cast("int"), F.lit(1), F.lit(4)), F.weekday(F.make_date(F.regexp_extract(c, week, 1).try_cast("int"), F.lit(1), F.lit(4))))
    days = (F.regexp_extract(c, week, 2).try_cast("int") - 1) * 7 + F.coalesce(F.regexp_extract(c, week, 3).try_cast("int"), F.lit(1)) - 1
    return F.coalesce(
        at(r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
        at(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
        F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d\d$"), F.try_to_timestamp(short, F.lit("M/d/y")).cast("timestamp_ntz")),
        at(r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
        at(r"^\d{8}$", "yyyyMMdd"),
        F.when(c.rlike(week), F.date_add(monday, days).cast("timestamp_ntz")),
        F.when(c.rlike(iso), F.coalesce(zoned, full.try_cast("timestamp_ntz"))),
    )


def number_text(c: Column) -> Column:
    """At most four decimals; whole numbers without any."""
    r = F.bround(c, 4)
    whole = r == F.floor(r)
    return F.when(whole & (F.abs(r) < 1e15), r.cast("decimal(38,0)").cast("string")).otherwise(float_text(r))


def rounded(c: Column) -> Column:
    return F.bround(c.cast("double"), 4)
