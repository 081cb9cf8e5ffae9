"""Lists of strings as JSON text, with separators and escapes of the stored table's format.

Fixed format: items separated by comma and blank; everything outside printable ASCII escaped
as ``\\uXXXX`` in lower-case hex, above the basic plane as a surrogate pair.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestrata.functions.scalars import col

_NAMED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))


def _sign(c: Column) -> Column:
    n = F.ascii(c)
    out = F.when(n > 0xFFFF, F.concat(_unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), _unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF))))
    for sign, text in _NAMED.items():
        out = out.when(c == F.lit(sign), F.lit(text))
    return out.when((n < 32) | (n > 126), _unit(n)).otherwise(c)


def json_string(x: Column) -> Column:
    """A string as a JSON literal; plain strings take the short way."""
    plain = F.concat(F.lit('"'), x, F.lit('"'))
    slow = F.concat(F.lit('"'), F.array_join(F.transform(F.split(x, ""), _sign), ""), F.lit('"'))
    return F.when(x.rlike(r"^[ !#-\[\]-~]*\z"), plain).otherwise(slow)


def list_to_json(x: Column | str) -> Column:
    """JSON text of an array of strings. A null array stays null; a null item is ``null``."""
    items = F.transform(col(x), lambda i: F.coalesce(json_string(i), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def json_to_list(x: Column | str) -> Column:
    """The array of strings of a JSON list; null if the text is null or no list."""
    return F.from_json(col(x), "array<string>")
