"""Element types of the nested symbol arrays, and constructors for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTION = (
    "struct<name:string,receiver:string,parameters:array<string>,returns:array<string>,"
    "line:int,exported:boolean>"
)
TYPE = "struct<name:string,kind:string,fields:array<string>,line:int,exported:boolean>"
ROUTE = "struct<method:string,path:string,handler:string,line:int>"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def function(
    name: Column,
    line: Column,
    exported: Column,
    receiver: Column | None = None,
    parameters: Column | None = None,
    returns: Column | None = None,
) -> Column:
    strings = "array<string>"
    return F.struct(
        name.alias("name"),
        (F.lit(None).cast("string") if receiver is None else receiver).alias("receiver"),
        (F.lit(None).cast(strings) if parameters is None else parameters).alias("parameters"),
        (F.lit(None).cast(strings) if returns is None else returns).alias("returns"),
        line.cast("int").alias("line"),
        exported.alias("exported"),
    )


def type_(
    name: Column, kind: Column, line: Column, exported: Column, fields: Column | None = None
) -> Column:
    return F.struct(
        name.alias("name"),
        kind.alias("kind"),
        (F.lit(None).cast("array<string>") if fields is None else fields).alias("fields"),
        line.cast("int").alias("line"),
        exported.alias("exported"),
    )


def route(method: Column, path: Column, handler: Column, line: Column) -> Column:
    return F.struct(
        method.alias("method"),
        path.alias("path"),
        handler.alias("handler"),
        line.cast("int").alias("line"),
    )


def public(name: Column) -> Column:
    """Python and Dart: a leading underscore hides a name."""
    return ~name.startswith("_")


def exported_names(symbols: Column) -> Column:
    return F.transform(F.filter(symbols, lambda s: s["exported"]), lambda s: s["name"])
