"""Column expressions for catalogue text: durations, calendar text, ratings, lists, row rendering. All built-in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a missing value in delimited files.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Season of a month, minimum age of a rating.
SEASONS = {"Dec": "winter", "Jan": "winter", "Feb": "winter", "Mar": "spring", "Apr": "spring", "May": "spring", "Jun": "summer", "Jul": "summer", "Aug": "summer", "Sep": "autumn", "Oct": "autumn", "Nov": "autumn"}
RATINGS = {"G - All Ages": 0, "PG - Children": 7, "PG-13 - Teens 13 or older": 13, "R - 17+ (violence & profanity)": 18, "R+ - Mild Nudity": 18}
UNKNOWN = "Unknown"

_UNITS = {"hr.": 3600, "min.": 60, "sec.": 1}


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def na_to_null(c: Column) -> Column:
    """NULL for any spelling of a missing value, else the text."""
    return F.when(~c.isin(NA_VALUES), c)


def tokens(c: Column) -> Column:
    """Whitespace tokens, Unicode white space included, no empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def duration_seconds(c: Column) -> Column:
    """Sum over every `<number> <unit>` of the number times the unit's seconds; anything else counts nothing."""
    total = F.lit(0)
    for unit, seconds in _UNITS.items():
        numbers = F.regexp_extract_all(c, F.lit(rf"(?:^|\s)(\d+)\s+{unit.replace('.', '[.]')}(?=\s|$)"), F.lit(1))
        total = total + F.aggregate(numbers, F.lit(0), lambda a, n: a + F.coalesce(n.try_cast("int"), F.lit(0))) * seconds
    return total


def without_commas(c: Column) -> Column:
    return F.translate(c, ",", "")


def season(c: Column) -> Column:
    """Season of the month that the first token names, else Unknown."""
    return F.coalesce(F.try_element_at(literal_map(SEASONS), F.get(tokens(c), F.lit(0))), F.lit(UNKNOWN))


def year(c: Column) -> Column:
    """The first token of four digits, else NULL."""
    return F.get(F.filter(tokens(c), lambda t: t.rlike(r"^\d{4}$")), F.lit(0)).cast("int")


def mapped_or_error(c: Column, pairs: dict, what: str) -> Column:
    """The value of a key; an unknown key is an error that names it, NULL stays NULL."""
    known = F.try_element_at(literal_map(pairs), c)
    wrong = F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("int")
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(known, wrong))


def rating_age(c: Column) -> Column:
    return mapped_or_error(c, RATINGS, "rating")


def split_list(c: Column, separator: str = ", ") -> Column:
    return F.split(c, separator)


# --- a row as text ----------------------------------------------------------


@F.pandas_udf(T.StringType())
def _python_repr(x):  # numbers that Spark and Python print in different ways
    return x.map(lambda v: None if v is None or v != v else repr(float(v)))


def render(name: str, kind: T.DataType) -> Column:
    """A value as Python prints it inside a dict; NULL is `nan`."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        # control characters are written as escapes, of which the backslash is removed later
        for raw, text in (("\\", ""), ("\n", "n"), ("\r", "r"), ("\t", "t")):
            c = F.replace(c, F.lit(raw), F.lit(text))
        return F.coalesce(c, F.lit("nan"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c, a = c.cast("double"), F.abs(c)
        plain = (a == 0) | (a >= 1e-3) & (a < 1e7)
        whole = (a >= 1e7) & (a < 1e16) & (c == F.floor(c))
        text = F.when(plain, c.cast("string")).when(whole, F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(_python_repr(c))
        return F.coalesce(text, F.lit("nan"))
    return F.coalesce(c.cast("string"), F.lit("nan"))


def doc_text(df: DataFrame, columns: list[str]) -> Column:
    """Names and values of a row in one lower-case text of word characters and white space."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [x for n in columns for x in (F.lit(n), render(n, kinds[n]))]
    return F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), r"(?U)[^\p{L}\p{N}_\s]", "")
