"""Dart symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import patterns as P
from codeloom.functions import symbols as sym
from codeloom.functions.text import captures, contains_any, hits, let


def imports(content: Column) -> Column:
    return F.array_distinct(captures(content, P.DART_IMPORT, ("import",)))


def functions(content: Column) -> Column:
    return F.transform(
        F.filter(
            hits(content, P.DART_FUNCTION, ("(",), 1), lambda h: ~h["g1"].isin(*P.DART_KEYWORDS)
        ),
        lambda h: sym.function(h["g1"], h["line"], sym.public(h["g1"])),
    )


def types(content: Column) -> Column:
    def of(pattern: str, kind: str) -> Column:
        return F.transform(
            hits(content, pattern, (kind,), 1),
            lambda h: sym.type_(h["g1"], F.lit(kind), h["line"], sym.public(h["g1"])),
        )

    return F.concat(of(P.DART_CLASS, "class"), of(P.DART_ENUM, "enum"), of(P.DART_MIXIN, "mixin"))


def exports(content: Column, functions: Column, types: Column) -> Column:
    return F.concat(
        captures(content, P.DART_EXPORT, ("export",)),
        sym.exported_names(functions),
        sym.exported_names(types),
    )


# Marks an opening bracket that an arrow and a word behind a closing one follow in its
# line. Only there may a route have parameters, so a bracket that is searched for its
# arrow always finds one, and what it has searched is then part of its route.
_ARROW_AHEAD = "\ufdd5"
_ROUTE = P.DART_ROUTE.replace(r"(?:\(", rf"(?:{_ARROW_AHEAD}\(")
_UP_TO_ARROW = rf"(?d).*\){P.S}*+=>{P.S}*+\w|[^\n]++|\n"


def _marked(content: Column) -> Column:
    def mark(part: Column) -> Column:
        return F.when(
            part.rlike(rf"\){P.S}*+=>{P.S}*+\w\z"), F.replace(part, F.lit("("), F.lit(_ARROW_AHEAD + "("))
        ).otherwise(part)

    parts = F.regexp_extract_all(content, F.lit(_UP_TO_ARROW), F.lit(0))
    return F.when(
        content.contains("=>"), F.array_join(F.transform(parts, mark), "")
    ).otherwise(content)


def routes(content: Column) -> Column:
    needles = ("'/", '"/')

    def found(marked: Column) -> Column:
        return F.transform(
            hits(marked, _ROUTE, needles, 1, 2),
            lambda h: sym.route(
                F.lit("GET"), F.replace(h["g1"], F.lit(_ARROW_AHEAD), F.lit("")), h["g2"], h["line"]
            ),
        )

    return let(_marked(content), found, when=contains_any(content, needles))
