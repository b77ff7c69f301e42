"""Text predicates used by profiling, detection and cleaning. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell contents that stand for "no value" (compared after trimming and lower-casing).
NULL_TOKENS = ["", " ", "na", "n/a", "null", "none", "nan", "-"]

# Cell contents a CSV read turns into NULL (exact, case-sensitive, untrimmed).
CSV_NULL_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Semantic patterns in the order in which they are tried.
# \A and \z bind to the whole value, so a trailing line break does not match.
PATTERNS = {
    "email": r"(?i)\A[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\z",
    "cpf": r"\A\d{3}[.\-]?\d{3}[.\-]?\d{3}-?\d{2}\z",
    "cnpj": r"\A\d{2}[.\-]?\d{3}[.\-]?\d{3}/?\d{4}-?\d{2}\z",
    "cep": r"\A\d{5}-?\d{3}\z",
    "phone": r"\A(?:\+?55\s?)?\(?\d{2}\)?[\s\-]?\d{4,5}[\-\s]?\d{4}\z",
    "plate": r"(?i)\A[A-Z]{3}-?(?:\d{4}|\d[A-Z]\d{2})\z",
    "date_br": r"\A\d{1,2}/\d{1,2}/\d{4}\z",
    "url": r"(?i)\Ahttps?://\S+\z",
}

# Numbers as a plain table reader takes them: no digit grouping, no hex, no type suffix.
NUMBER = r"(?i)\A[+\-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+\-]?\d+)?|inf|infinity)\z"
INTEGER = r"\A[+\-]?\d+\z"

# Dates in text. A family of shapes is told by single characters; one expression then accepts it and rewrites it to ISO order.
# Years from 1678 to 2262.
_YEAR = r"(?:16(?:7[89]|[89]\d)|1[7-9]\d\d|2[01]\d\d|22(?:[0-5]\d|6[0-2]))"
_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?"
_ISO = rf"\A{_YEAR}-(?:\d{{2}}|\d{{1,2}}-\d{{1,2}}|\d{{2}}-\d{{2}}[ T]{_TIME}(?: ?Z| ?[+\-]\d{{2}}:?\d{{2}})?)\z"
_YEAR_FIRST = rf"\A{_YEAR}/\d{{1,2}}/\d{{1,2}}\z"
# Two numbers and the year; only slashes may have a time behind them.
_YEAR_LAST = rf"\A(\d{{1,2}})(?:/(?=\d{{1,2}}/)|-(?=\d{{1,2}}-\d{{4}}\z)|\.(?=\d{{1,2}}\.\d{{4}}\z))(\d{{1,2}})[/.\-]({_YEAR})((?: \d{{1,2}}:\d{{2}}(?::\d{{2}})?)?)\z"
_CLOCK = rf"\A(?:\d{{1,2}}/\d{{1,2}}/{_YEAR}|{_YEAR}-\d{{2}}-\d{{2}}) \d{{1,2}}:\d{{2}}(?::\d{{2}})? ?[AaPp][Mm]\z"
_NAMED = rf"\A(?:[A-Z][a-z]{{2,8}} \d{{1,2}},? {_YEAR}|\d{{1,2}} [A-Z][a-z]{{2,8}} {_YEAR}|\d{{1,2}}-[A-Z][a-z]{{2}}-{_YEAR})\z"
# English names of the months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` removes only U+0020)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def is_null_token(c: Column) -> Column:
    """Any letter case, after trimming: what profiling counts."""
    return F.lower(strip(c)).isin(NULL_TOKENS)


def is_exact_null_token(c: Column, match: str = "exact") -> Column:
    """All lower case or all upper case: what cleaning replaces unless told otherwise."""
    if match == "insensitive":
        return F.lower(c).isin(NULL_TOKENS)
    return c.isin(sorted(set(NULL_TOKENS) | {t.upper() for t in NULL_TOKENS}))


def is_number(stripped: Column) -> Column:
    return stripped.rlike(NUMBER)


def to_number(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_datetime(stripped: Column) -> Column:
    """Timestamp or NULL.

    Read are ISO dates with or without time and zone, years and year-months, ``yyyyMMdd``, two numbers and the year (month first
    unless the first number can only be a day) with slashes, dashes or dots, English month names, 12-hour clocks, and bare
    times (of 1970-01-01: they say nothing about a day). First, third, fifth and last characters tell the family, so that a cell
    meets one or two regular expressions whatever it holds; an impossible month or day makes it NULL.
    """
    s, size = stripped, F.char_length(stripped)
    char = lambda k: F.substring(s, k, 1)
    last = F.right(s, F.lit(1))
    second_or_third = lambda *of: char(2).isin(*of) | char(3).isin(*of)
    day_first = (~char(2).isin("/", "-", ".")) & (F.substring(s, 1, 2) > "12")

    zone = F.regexp_replace(s, r" ?([+\-]\d{2}):?(\d{2})\z", "$1:$2")
    iso = F.when(size <= 16, s).when(last == "Z", F.replace(s, F.lit(" Z"), F.lit("Z"))).when(F.substring(s, -6, 6).rlike(r"[+\-]"), zone).otherwise(s)
    compact = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2))
    months = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS, 1) for name in sorted({m, m[:3]}) for x in (name, f"-{k}-")])
    number = F.try_element_at(months, F.regexp_extract(s, "[A-Z][a-z]+", 0))
    named = F.concat(F.right(s, F.lit(4)), number, F.regexp_extract(s, r"\d{1,2}", 0))
    text = (
        F.when(~size.between(4, 40), None)
        .when(char(1).between("A", "Z") | (size.between(10, 17) & F.substring(s, 3, 2).rlike("[A-Z]")), F.when(s.rlike(_NAMED), named))
        .when(~char(1).between("0", "9"), None)
        .when(second_or_third("/", "-", "."), F.when(s.rlike(_YEAR_LAST), F.regexp_replace(s, _YEAR_LAST, F.when(day_first, "$3-$2-$1$4").otherwise("$3-$1-$2$4"))))
        .when(second_or_third(":"), F.when(s.rlike(rf"\A{_TIME}\z"), F.concat(F.lit("1970-01-01 "), s)))
        .when(char(5) == "-", F.when(s.rlike(_ISO), iso))
        .when(char(5) == "/", F.when(s.rlike(_YEAR_FIRST), F.replace(s, F.lit("/"), F.lit("-"))))
        .when(size == 8, F.when(s.rlike(rf"\A{_YEAR}\d{{4}}\z"), compact))
        .when(size == 4, F.when(s.rlike(rf"\A{_YEAR}\z"), s))
    )
    date = F.when(char(5) == "-", "yyyy-MM-dd").when(day_first, "d/M/yyyy").otherwise("M/d/yyyy")
    form = F.concat(date, F.when(F.regexp_count(s, F.lit(":")) == 2, " h:mm:ss a").otherwise(" h:mm a"))
    spoken = F.try_to_timestamp(F.upper(F.regexp_replace(s, r" ?([AaPp][Mm])\z", " $1")), form)
    return F.when(last.isin("m", "M"), F.when(s.rlike(_CLOCK), spoken)).otherwise(text.try_cast("timestamp"))
