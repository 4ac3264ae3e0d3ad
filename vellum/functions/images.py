"""Row images: the before/after column values a change record carries.

Images are ``MAP<STRING,STRING>`` so one ledger serves any table.  The legacy
text forms (brace ``{k=v k2=v2}`` and comma list with ``\\,`` escapes) are
parsed and written with regex/array built-ins, never Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.predicates import py_strip

# The field order of the legacy fixed-layout image.
LEGACY_FIELDS = ["id", "first_name", "last_name", "email", "gender",
                 "ip_address", "is_active", "data"]

# Brace-form pair pattern (a word key, '=', text up to the next
# ' key=' or the end) and the texts that mean "no image".
BRACE_PAIR = r"(\w+)=([^=]*?)(?=\s+\w+=|$)"
EMPTY_IMAGE_TEXTS = [",", "{}", "", "null"]


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A lambda that mentions an outer expression re-evaluates it for every
    array element; binding it first keeps each regex pass to one per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _clean_value(v: Column) -> Column:
    # strip whitespace, then commas, then whitespace again -- as one regex
    return F.regexp_replace(v, r"^\s*,*\s*|\s*,*\s*$", "")


_EMPTY = "map<string,string>"

# one comma-led field: plain text, then escaped characters with plain text behind them
_FIELD = r"(?s),([^\\,]*+(?:\\.[^\\,]*+)*+)"


def _escaped_fields(s: Column) -> Column:
    """The fields of a comma list, ``\\x`` read as ``x`` (so ``\\\\,`` ends a field).  Texts without a backslash skip the regex."""
    has = lambda c: c.contains("\\")
    raw = F.regexp_extract_all(F.concat(F.lit(","), s), F.lit(_FIELD), 1)
    plain = F.transform(raw, lambda x: F.when(has(x), F.regexp_replace(x, r"(?s)\\(.)", "$1")).otherwise(x))
    return F.when(has(s), plain).otherwise(F.split(s, ","))


def unpack_sorted_image(c: Column, columns: list[str]) -> Column:
    """Legacy image text whose values follow the columns' names in alphabetical
    order (F6): split on every comma, then ``\\|`` and ``\\,`` restored; absent
    columns are ``''``, blank text is an empty map."""
    names = _lit_array(sorted(columns))
    filled = _let(F.split(c, ","), lambda parts: F.map_from_arrays(names, F.transform(names, lambda f, i: F.coalesce(
        F.replace(F.replace(F.try_element_at(parts, i + 1), F.lit("\\|"), F.lit("|")), F.lit("\\,"), F.lit(",")), F.lit("")))))
    return F.when(c.isNull() | (py_strip(c) == ""), F.create_map().cast(_EMPTY)).otherwise(filled)


def _pairs_to_map(pairs: Column) -> Column:
    """array<struct<k,v>> -> map, a repeated key keeps its last value."""
    empty = F.create_map().cast(_EMPTY)
    return F.aggregate(pairs, empty, lambda acc, x: F.map_concat(
        F.map_filter(acc, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))


def _with_fields(parsed: Column, fields: list[str]) -> Column:
    """All known fields present ('' when absent) plus every parsed key."""
    defaults = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(""))])
    return _let(parsed, lambda p: F.map_concat(
        F.map_filter(defaults, lambda k, v: ~F.map_contains_key(p, k)), p))


def unpack_image(c: Column, fields: list[str] | None = None) -> Column:
    """Legacy image text -> MAP<STRING,STRING>.

    brace form ``{k=v ...}``: pairs by regex, values trimmed of spaces and
    commas; comma form: read character by character (``\\x`` -> ``x``), mapped to
    ``fields`` in order.  Missing known fields become ''.  Blank, ``,``,
    ``{}`` and ``null`` give an empty map.  Outer commas are not stripped
    (stripping shifts fields when the first one is blank).
    """
    fields = fields or LEGACY_FIELDS
    empty = F.create_map().cast(_EMPTY)

    def parse(s: Column) -> Column:
        content = py_strip(F.regexp_replace(s, r"^\{|\}$", ""))
        # whole 'key=value' matches; the value holds no '=', so split at the first
        matches = F.regexp_extract_all(content, F.lit(BRACE_PAIR), 0)
        pairs = F.transform(matches, lambda m: F.struct(
            F.substring_index(m, "=", 1).alias("k"),
            _clean_value(F.substring_index(m, "=", -1)).alias("v")))
        brace = F.when(content == "", empty).otherwise(_with_fields(_pairs_to_map(pairs), fields))
        comma = _let(_escaped_fields(s), lambda parts: F.map_from_arrays(
            _lit_array(fields),
            F.transform(_lit_array(fields), lambda f, i: F.coalesce(F.try_element_at(parts, i + 1), F.lit("")))))
        return (F.when(s.isNull() | s.isin(EMPTY_IMAGE_TEXTS), empty)
                .when(s.startswith("{") & s.endswith("}"), brace)
                .otherwise(comma))

    # no lambda around the whole parser: expressions outside lambdas stay in
    # generated code, and the repeated strip is shared by subexpression
    # elimination
    return parse(py_strip(c))


def pack_image(image: Column, fields: list[str] | None = None) -> Column:
    """MAP image -> legacy comma text (F7); ',' and '|' escaped, '' if empty."""
    fields = fields or LEGACY_FIELDS
    vals = [F.regexp_replace(F.regexp_replace(
        F.coalesce(F.try_element_at(image, F.lit(f)), F.lit("")), r",", r"\\,"), r"\|", r"\\|")
        for f in fields]
    return F.when(image.isNull() | (F.size(image) == 0), F.lit("")).otherwise(F.concat_ws(",", *vals))


def clean_json(c: Column) -> Column:
    """Compact re-serialisation of JSON text (F8); invalid or empty -> '{}'.

    Doubled-quote escaping from old exports (four quotes) is undone first.
    """
    s = F.replace(c, F.lit('""""'), F.lit('"'))
    return (F.when(c.isNull() | c.isin("", "{}"), F.lit("{}"))
            .otherwise(F.coalesce(F.to_json(F.try_parse_json(s)), F.lit("{}"))))
