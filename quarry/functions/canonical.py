"""Canonical JSON of nested columns: keys in code point order, no blanks, text unescaped but for what JSON demands.

The result is that of ``json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)``, so a digest of it
can be checked by any other reader.  Null is ``null``, at every level.  Fractions have no one spelling and are refused:
give them as text, or as whole thousandths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters with a short escape of their own.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    odd = out
    for n in range(32):
        odd = F.replace(odd, F.lit(chr(n)), F.lit(_SHORT.get(chr(n), f"\\u{n:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), odd).otherwise(out), F.lit('"'))


def to_json(column: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of a type: text, whole numbers, booleans, and arrays, structs and maps of them."""
    if isinstance(kind, T.StringType):
        out = quoted(column)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = column.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: to_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        by_key = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(quoted(k), F.lit(":"), to_json(F.element_at(column, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(by_key, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), to_json(column[f.name], f.dataType)) for f in fields]
        out = F.when(column.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def digest(column: Column, kind: T.DataType) -> Column:
    """sha256, in lowercase hex, of a column's canonical JSON."""
    return F.sha2(to_json(column, kind), 256)
