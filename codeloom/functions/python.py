"""Python symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import patterns as P
from codeloom.functions import symbols as sym
from codeloom.functions.text import captures, hits


def imports(content: Column) -> Column:
    return F.array_distinct(
        F.concat(
            captures(content, P.PY_IMPORT, ("import",)),
            captures(content, P.PY_FROM_IMPORT, ("from",)),
        )
    )


def functions(content: Column) -> Column:
    return F.transform(
        hits(content, P.PY_FUNCTION, ("def",), 1),
        lambda h: sym.function(h["g1"], h["line"], sym.public(h["g1"])),
    )


def routes(content: Column) -> Column:
    return F.transform(
        hits(content, P.PY_ROUTE, ("@",), 1, 2, 3),
        lambda h: sym.route(F.upper(h["g1"]), h["g2"], h["g3"], h["line"]),
    )


def types(content: Column) -> Column:
    return F.transform(
        hits(content, P.PY_CLASS, ("class",), 1),
        lambda h: sym.type_(h["g1"], F.lit("class"), h["line"], sym.public(h["g1"])),
    )


def exports(content: Column, functions: Column, types: Column) -> Column:
    """Public functions, then public classes; ``__all__`` replaces both."""
    listed = F.regexp_extract(content, P.PY_ALL, 1)
    items = F.filter(
        F.transform(
            F.split(listed, ","),
            lambda item: F.btrim(F.btrim(item, F.lit(P.WHITE_SPACE)), F.lit("'\"")),
        ),
        lambda item: item != "",
    )
    return F.when(content.contains("__all__") & (listed != ""), items).otherwise(
        F.concat(sym.exported_names(functions), sym.exported_names(types))
    )
