"""JSON texts whose bytes are fixed: sorted keys, a space behind commas and colons, one way to escape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NullType, StringType, StructType

#: Characters with a short escape (fixed values of JSON).
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
OTHERS = [chr(i) for i in range(32) if chr(i) not in SHORT]


def quoted(text: Column, ascii_only: bool) -> Column:
    """A string of JSON; null is null. ascii_only: what isn't printable ASCII as escaped UTF-16 units, else as it is."""
    out = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(SHORT[c])), ["\\", *(c for c in SHORT if c != "\\")], text)
    rare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"\\u{ord(c):04x}")), OTHERS, out)
    out = F.when(text.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f]"), rare).otherwise(out)
    if ascii_only:
        units = F.hex(F.encode(out, "UTF-16BE"))

        def one(i: Column) -> Column:
            unit = F.substring(units, i * 4 - 3, F.lit(4))
            return F.when(unit < "007F", F.chr(F.conv(unit, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))

        out = F.when(text.rlike("[^\\x00-\\x7e]"), F.array_join(F.transform(F.sequence(F.lit(1), (F.length(units) / 4).cast("int")), one), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def written(value: Column, kind: DataType, ascii_only: bool = True) -> Column:
    """A value as JSON text. Structs and maps (with text keys) list their keys in order; null is null. Fractions have
    no one text, so their types are refused."""
    if isinstance(kind, StringType):
        out = quoted(value, ascii_only)
    elif isinstance(kind, IntegralType | BooleanType):
        out = value.cast("string")
    elif isinstance(kind, NullType):
        return F.lit("null")
    elif isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name), ascii_only), F.lit(": "), written(value[f.name], f.dataType, ascii_only)) for f in fields]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: written(x, kind.elementType, ascii_only)), ", "), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        pair = lambda e: F.concat(quoted(e["key"], ascii_only), F.lit(": "), written(e["value"], kind.valueType, ascii_only))
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ", "), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical text")
    return F.coalesce(out, F.lit("null"))
