"""Typed access to a record's fields, with a default for what is missing.

Each takes a column or its name, with dots for nested fields, and returns a Column,
so Catalyst sees through a transform and prunes columns and pushes filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "EMPTY"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def get(c: Column | str) -> Column:
    """The field as it is; also a nested record."""
    return _column(c)


get_record = get


def field(c: Column | str, *names: str) -> Column:
    """A field of nested records: ``field("a", "b", "c")`` is a.b.c."""
    out = _column(c)
    for n in names:
        out = out.getField(n)
    return out


def get_long(c: Column | str, default: int | None = None) -> Column:
    """An integer; booleans are 1 and 0, text is parsed and raises if it can't be."""
    return F.coalesce(_column(c).cast("bigint"), F.lit(default).cast("bigint"))


def get_int(c: Column | str, default: int | None = None) -> Column:
    return F.coalesce(_column(c).cast("int"), F.lit(default).cast("int"))


def get_double(c: Column | str, default: float | None = None) -> Column:
    """A double; text is parsed and raises if it can't be."""
    return F.coalesce(_column(c).cast("double"), F.lit(default).cast("double"))


def get_float(c: Column | str, default: float | None = None) -> Column:
    return F.coalesce(_column(c).cast("float"), F.lit(default).cast("float"))


def try_long(c: Column | str, default: int | None = None) -> Column:
    """As ``get_long``, but what can't be parsed is the default."""
    return F.coalesce(_column(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def try_double(c: Column | str, default: float | None = None) -> Column:
    return F.coalesce(_column(c).try_cast("double"), F.lit(default).cast("double"))


def get_boolean(c: Column | str, default: bool | None = None) -> Column:
    """True for true, the text ``true`` in any case, and 1, as a number or text; other texts and numbers are false."""
    said = F.lower(_column(c).cast("string"))
    return F.coalesce((said == "true") | F.coalesce(said.try_cast("double") == 1, F.lit(False)), F.lit(default).cast("boolean"))


def get_string(c: Column | str, default: str | None = None, empty_is_missing: bool = False) -> Column:
    out = _column(c).cast("string")
    return F.coalesce(F.nullif(out, F.lit("")) if empty_is_missing else out, F.lit(default).cast("string"))


def get_array(c: Column | str) -> Column:
    return _column(c)


def element(c: Column | str, index: int) -> Column:
    """The element at a zero-based index, NULL beyond the end."""
    return F.get(_column(c), F.lit(index))


def get_map(c: Column | str, key: str | None = None) -> Column:
    return _column(c) if key is None else F.element_at(_column(c), F.lit(key))


def get_data(c: Column | str = "value") -> Column:
    """The whole line of a text source."""
    return _column(c)


def split_line(c: Column | str = "value", separator: str = "\t") -> Column:
    """The fields of a line, trailing empty ones included."""
    return F.split(_column(c), f"\\Q{separator}\\E", -1)


def json_field(c: Column | str, path: str) -> Column:
    """A field of a JSON text, as text."""
    return F.get_json_object(_column(c), path if path.startswith("$") else f"$.{path}")


def is_empty(c: Column | str) -> Column:
    """NULL, blank, or the literal ``EMPTY``."""
    said = F.trim(_column(c).cast("string"))
    return said.isNull() | (said == "") | (said == EMPTY)
