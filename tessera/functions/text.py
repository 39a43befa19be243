"""Column expressions for keys, annotation fields and strict JSON; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_key(s: Column) -> Column:
    """Capital ASCII letters and digits alone."""
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def collapse_key(s: Column, prefixes: tuple[str, ...] = ("HERV", "ERV")) -> Column:
    """The normalised key without one leading prefix."""
    return without_prefix(normalize_key(s), prefixes)


def without_prefix(key: Column, prefixes: tuple[str, ...] = ("HERV", "ERV")) -> Column:
    """What ``collapse_key`` gives of a key that is normalised already; longer prefixes come before shorter ones."""
    found = F.when(F.lit(False), key)
    for p in prefixes:
        found = found.when(F.startswith(key, F.lit(p)), F.substr(key, F.lit(len(p) + 1)))
    return found.otherwise(key)


def packed_tokens(s: Column) -> Column:
    """A comma-packed string itself and its trimmed parts, each once, without empty ones."""
    parts = F.transform(F.split(s, ","), lambda t: F.trim(t))
    return F.filter(F.array_distinct(F.concat(F.array(s), parts)), lambda t: t != "")


def quoted_attribute(attributes: Column, key: str) -> Column:
    """The value of ``key "value"`` in an attribute field; the key must stand alone; null if absent or empty."""
    return F.nullif(F.regexp_extract(attributes, f'(?:^|[; ]){key} "([^"]*)"', 1), F.lit(""))


def class_of(class_family: Column) -> Column:
    return F.get(F.split(class_family, "/", 2), F.lit(0))


def family_of(class_family: Column) -> Column:
    """What follows the first slash, or all of it without one."""
    parts = F.split(class_family, "/", 2)
    return F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))


def strand_of(mark: Column) -> Column:
    return F.when(mark == "C", "-").otherwise("+")


def integer_list(packed: Column) -> Column:
    """``"1,2,"`` to an array; null gives an empty one."""
    parts = F.filter(F.split(F.coalesce(packed, F.lit("")), ","), lambda t: F.trim(t) != "")
    return F.transform(parts, lambda t: F.trim(t).cast("long"))


def finite(x: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def finite_deep(c: Column, kind: T.DataType) -> Column:
    """``c`` with every floating-point leaf made ``finite``, through arrays and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_deep(x, kind.elementType))
    if isinstance(kind, T.StructType):
        made = F.struct(*[finite_deep(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    return c


def strict_json(c: Column, kind: T.DataType) -> Column:
    """Compact JSON with nulls kept and without NaN or infinities."""
    return F.to_json(finite_deep(c, kind), {"ignoreNullFields": "false"})


def is_strict_json(text: Column) -> Column:
    """Whether a text is one JSON value by the letter of the standard; null is not."""
    return text.isNotNull() & F.try_parse_json(text).isNotNull()


def position_1based(chrom: Column, start0: Column, end0: Column, pad: int = 0) -> Column:
    """``chrom:start-end``, 1-based inclusive, padded and clamped at 1."""
    return F.concat(chrom, F.lit(":"), F.greatest(start0 + 1 - pad, F.lit(1)).cast("string"), F.lit("-"), (end0 + pad).cast("string"))
