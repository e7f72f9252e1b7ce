"""Rows as clients get them: camelCase names, defaults for nulls, ISO text for times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from galleon.functions.columns import iso_text

#: Names of the columns that are filled with a default where they are null.
ZERO = ("score", "rating", "width", "height")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def client_form(c: Column, kind: T.DataType, name: str = "") -> Column:
    """A value as clients get it; structs and lists of structs are gone through at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[client_form(c[f.name], f.dataType, f.name).alias(camel(f.name)) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            c = F.transform(c, lambda x: client_form(x, kind.elementType))
        return F.coalesce(c, F.array())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.StringType) and name.endswith("_at"):
        return iso_text(c)
    return F.coalesce(c, F.lit(0).cast(kind)) if name in ZERO else c


def shaped(df: DataFrame) -> DataFrame:
    """Times become ISO text, unset numbers 0, missing lists empty, names camelCase, inside nested values too."""
    return df.select(*[client_form(F.col(f.name), f.dataType, f.name).alias(camel(f.name)) for f in df.schema.fields])
