"""JavaScript and TypeScript symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import patterns as P
from codeloom.functions import symbols as sym
from codeloom.functions.text import captures, contains_any, hits, let


def imports(content: Column) -> Column:
    return F.array_distinct(
        F.concat(
            captures(content, P.JS_IMPORT, ("import",)),
            captures(content, P.JS_REQUIRE, ("require(",)),
            captures(content, P.JS_DYNAMIC_IMPORT, ("import(",)),
        )
    )


def exports(content: Column) -> Column:
    named = captures(content, P.JS_EXPORT_NAMED, ("export",))
    default = F.transform(
        captures(content, P.JS_EXPORT_DEFAULT, ("default",)),
        lambda name: F.when(name == "", "default").otherwise(name),
    )
    module = F.when(
        content.contains("module.exports") & content.rlike(P.JS_MODULE_EXPORTS),
        F.array(F.lit("module.exports")),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(named, default, module)


def exported_tokens(content: Column) -> Column:
    """Every word that follows ``export`` on an export line: a symbol counts as
    exported when it is one of them, wherever on the line it stands."""
    tails = F.array_join(captures(content, P.JS_EXPORT_TAIL, ("export",)), " ")
    return F.regexp_extract_all(tails, F.lit("[0-9A-Za-z_]++"), F.lit(0))


def functions(content: Column, tokens: Column) -> Column:
    """Declarations, then arrow functions; ``tokens`` are :func:`exported_tokens`."""

    def build(tokens: Column) -> Column:
        found = F.concat(
            hits(content, P.JS_FUNCTION, ("function",), 1), hits(content, P.JS_ARROW, ("=>",), 1)
        )
        return F.transform(
            found, lambda h: sym.function(h["g1"], h["line"], F.array_contains(tokens, h["g1"]))
        )

    return let(tokens, build, contains_any(content, ("function", "=>")), "array<string>")


def types(content: Column, tokens: Column) -> Column:
    kinds = {"class": P.JS_CLASS, "interface": P.JS_INTERFACE, "type": P.JS_TYPE}

    def build(tokens: Column) -> Column:
        def of(kind: str, pattern: str) -> Column:
            return F.transform(
                hits(content, pattern, (kind,), 1),
                lambda h: sym.type_(
                    h["g1"], F.lit(kind), h["line"], F.array_contains(tokens, h["g1"])
                ),
            )

        return F.concat(*[of(kind, pattern) for kind, pattern in kinds.items()])

    return let(tokens, build, contains_any(content, tuple(kinds)), "array<string>")


def routes(content: Column) -> Column:
    return F.transform(
        hits(content, P.JS_ROUTE, ("app.", "router."), 1, 2),
        lambda h: sym.route(F.upper(h["g1"]), h["g2"], F.lit(""), h["line"]),
    )


