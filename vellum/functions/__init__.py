"""Column -> Column helpers (all built-in Spark SQL expressions)."""

from vellum.functions.predicates import (
    blank, is_boolean, is_date, is_datetime, is_integer, is_number, py_strip,
)
from vellum.functions.images import clean_json, pack_image, unpack_image
from vellum.functions.keys import change_id, landing_key

__all__ = [
    "blank", "is_boolean", "is_date", "is_datetime", "is_integer", "is_number",
    "py_strip", "clean_json", "pack_image", "unpack_image", "change_id", "landing_key",
]
