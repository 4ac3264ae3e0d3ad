"""Cell-level type predicates used by contract validation.

Each predicate is a pure Column expression (regex + built-in date parsing),
so a whole table is checked inside whole-stage codegen with no Python UDF.
The grammar follows Python's ``int()``, ``float()`` and ``strptime`` on text,
which is what the contract checks were written against.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python int()/float() text grammar (ASCII digits).
INT_RE = r"^[+-]?\d+(_\d+)*$"
NUMBER_RE = (r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
             r"|^[+-]?(?i:inf|infinity|nan)$")

# Accepted boolean spellings (compared after lower-casing).
BOOL_WORDS = ["true", "false", "1", "0", "yes", "no", "sim", "não"]

# The date and date-time layouts a contract accepts, written as
# strptime directives (Y year, m month, d day, H hour, M minute, S second).
DATE_LAYOUTS = ["Y-m-d", "d/m/Y", "m/d/Y", "Y/m/d", "d-m-Y", "m-d-Y"]
DATETIME_LAYOUTS = ["Y-m-d H:M:S", "Y-m-d H:M", "d/m/Y H:M:S", "d/m/Y H:M",
                    "Y-m-dTH:M:S", "Y-m-dTH:M:SZ"]

# strptime's field grammar: width 1-2 parts, 4-digit year, day may be ' 5'.
_PART = {
    "Y": r"(\d{4})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(?:2[0-3]|[0-1]\d|\d)",
    "M": r"(?:[0-5]\d|\d)",
    "S": r"(?:[0-5]\d|\d)",  # 60 and 61 match strptime's regex but fail datetime()
}


# Every character that Python's str.strip() removes, from the rule itself.
_WHITESPACE = "".join(map(chr, filter(lambda i: chr(i).isspace(), range(0x3001))))


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``, Unicode whitespace included, without a regex."""
    return F.btrim(c, F.lit(_WHITESPACE))


def py_strip_some(c: Column) -> Column:
    """``py_strip`` for columns whose cells seldom need it (``c`` is evaluated more than once: give it a plain column).

    Trimming compares each end with every whitespace character, so it runs only
    on texts with an end outside ``!`` to ``~``, which are all no whitespace.
    """
    solid = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(solid, c).otherwise(py_strip(c))


def blank(c: Column) -> Column:
    """Null, or whitespace-only text."""
    return c.isNull() | (py_strip(c.cast("string")) == F.lit(""))


def is_integer(c: Column) -> Column:
    return py_strip(c.cast("string")).rlike(INT_RE)


def is_number(c: Column) -> Column:
    return py_strip(c.cast("string")).rlike(NUMBER_RE)


def is_boolean(c: Column) -> Column:
    return F.lower(c.cast("string")).isin(BOOL_WORDS)


def _layout_regex(layout: str) -> tuple[str, list[str]]:
    """Anchored regex for one layout plus the order of its Y/m/d groups."""
    out, order = ["^"], []
    for ch in layout:
        if ch in _PART:
            out.append(_PART[ch])
            if ch in "Ymd":
                order.append(ch)
        elif ch == " ":
            out.append(r"\s+")
        elif ch in "TZ":
            out.append(f"[{ch}{ch.lower()}]")  # strptime matches case-blind
        else:
            out.append("\\" + ch if ch in "/-:." else ch)
    out.append("$")
    return "".join(out), order


# Spark datetime patterns for each layout letter; single letters parse one or
# two digits, and the shape regex has already fixed the widths.
_SPARK_FIELD = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s"}


def _spark_pattern(layout: str) -> str:
    out = []
    for ch in layout:
        if ch in _SPARK_FIELD:
            out.append(_SPARK_FIELD[ch])
        elif ch in "TZ":
            out.append(f"'{ch}'")  # parsing is case-blind, like strptime
        else:
            out.append(ch)
    return "".join(out)


def _shape(layout: str) -> str:
    """The layout's anchored regex, with year 0000 excluded (no such year
    exists for datetime())."""
    rx, _ = _layout_regex(layout)
    return rx.replace(r"(\d{4})", r"(?!0000)(\d{4})")


def _valid_layout(s: Column, norm: Column, layout: str) -> Column:
    # the shape guard keeps strptime's field widths; Spark's parser then
    # rejects impossible days (Feb 30) and times
    return s.rlike(_shape(layout)) & F.try_to_timestamp(norm, F.lit(_spark_pattern(layout))).isNotNull()


def _normalised(s: Column) -> Column:
    """Text Spark's parser reads as strptime does: a space-padded day loses
    its pad, and any run of whitespace becomes one space.  Only text that
    contains whitespace is rewritten."""
    fixed = F.regexp_replace(F.regexp_replace(s, r"(^|[-/]) ([1-9])", "$1$2"), r"\s+", " ")
    return F.when(s.rlike(r"\s"), fixed).otherwise(s)


def _any_layout(c: Column, layouts: list[str]) -> Column:
    s = c.cast("string")
    norm = _normalised(s)
    anything = "|".join(f"(?:{_shape(layout)})" for layout in layouts)
    cond = F.lit(False)
    for layout in layouts:
        cond = cond | F.coalesce(_valid_layout(s, norm, layout), F.lit(False))
    # one combined regex turns away text that fits no layout at all
    return F.when(s.rlike(anything), cond).otherwise(F.lit(False))


def is_date(c: Column) -> Column:
    return _any_layout(c, DATE_LAYOUTS)


def is_datetime(c: Column) -> Column:
    return _any_layout(c, DATETIME_LAYOUTS)
