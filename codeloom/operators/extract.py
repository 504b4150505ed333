"""Symbols of each file, and the fact table they unfold to.

Everything here is a narrow projection over the file rows: the text is read
once, no row leaves its partition, and a file's cost depends on that file only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import dart, golang, javascript, python
from codeloom.functions.text import let

JS = ("JavaScript", "TypeScript")


def _by_language(js: Column, py: Column, dt: Column, go: Column) -> Column:
    language = F.col("language")
    return (
        F.when(language.isin(*JS), js)
        .when(language == "Python", py)
        .when(language == "Dart", dt)
        .when(language == "Go", go)
    )


def is_broken() -> Column:
    """Go files with syntax errors, which have no symbols and no node."""
    bare = golang.code(F.col("content"))
    return F.when(F.col("language") == "Go", ~golang.parses(bare)).otherwise(F.lit(False))


def _with_code(files: DataFrame, keep: tuple[str, ...], broken: bool) -> DataFrame:
    """The text to read symbols from. Broken files go by unfolding to no row: a filter
    would be moved below the column and compute its text once more."""
    content, is_go = F.col("content"), F.col("language") == "Go"
    if broken:
        code = F.when(is_go, golang.code(content)).otherwise(content)
    else:
        sound = let(golang.code(content), lambda c: F.when(golang.parses(c), F.array(c)))
        code = F.explode(F.when(is_go, sound).otherwise(F.array(content)))
    return files.select("project", "path", *keep, "language", code.alias("code")).withColumn(
        "tokens", F.when(F.col("language").isin(*JS), javascript.exported_tokens(F.col("code")))
    )


@lru_cache(maxsize=4)
def _symbol_columns(application: str) -> tuple[list[Column], Column]:
    """The extraction expressions; building them takes thousands of calls into
    the JVM, so each application builds them once."""
    code, tokens = F.col("code"), F.col("tokens")
    functions, types = F.col("functions"), F.col("types")
    found = [
        _by_language(
            javascript.functions(code, tokens),
            python.functions(code),
            dart.functions(code),
            golang.functions(code),
        ).alias("functions"),
        _by_language(
            javascript.imports(code), python.imports(code), dart.imports(code), golang.imports(code)
        ).alias("imports"),
        _by_language(
            javascript.routes(code), python.routes(code), dart.routes(code), golang.routes(code)
        ).alias("api_routes"),
        _by_language(
            javascript.types(code, tokens),
            python.types(code),
            dart.types(code),
            golang.all_types(code),
        ).alias("types"),
    ]
    exports = _by_language(
        javascript.exports(code),
        python.exports(code, functions, types),
        dart.exports(code, functions, types),
        golang.exports(functions, types),
    )
    return found, exports.alias("exports")


def file_nodes(files: DataFrame, keep: tuple[str, ...] = (), broken: bool = False) -> DataFrame:
    """One nested row per file: functions, imports, exports, api_routes, types.

    Files that are broken are left out unless asked for. Columns named in ``keep``
    are carried along."""
    found, exports = _symbol_columns(files.sparkSession.sparkContext.applicationId)
    base = ["project", "path", *keep, "language"]
    return (
        _with_code(files, keep, broken).select(*base, "code", *found)
        .select(*base, "functions", "imports", exports, "api_routes", "types")
    )


def facts(nodes: DataFrame) -> DataFrame:
    """The normalised table: one row per import, export, function, type or route."""
    fact = (
        "array<struct<kind:string,name:string,detail:string,line:int,ord:int,exported:boolean>>"
    )

    def row(kind: str, name: Column, ord_: Column, **rest: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            name.alias("name"),
            rest.get("detail", F.lit(None).cast("string")).alias("detail"),
            rest.get("line", F.lit(None).cast("int")).alias("line"),
            ord_.alias("ord"),
            rest.get("exported", F.lit(None).cast("boolean")).alias("exported"),
        )

    def each(column: str, build: Callable[[Column, Column], Column]) -> Column:
        return F.transform(column, build).cast(fact)

    unfolded = F.concat(
        each("imports", lambda x, i: row("import", x, i)),
        each("exports", lambda x, i: row("export", x, i)),
        each(
            "functions",
            lambda f, i: row(
                "function", f["name"], i,
                detail=f["receiver"], line=f["line"], exported=f["exported"],
            ),
        ),
        each(
            "types",
            lambda t, i: row(
                "type", t["name"], i, detail=t["kind"], line=t["line"], exported=t["exported"]
            ),
        ),
        each(
            "api_routes",
            lambda r, i: row("route", r["path"], i, detail=r["method"], line=r["line"]),
        ),
    )
    return nodes.select("project", "path", "language", F.inline(unfolded))


def _exploded(
    files: DataFrame, languages: tuple[str, ...], array: Callable[[Column], Column]
) -> DataFrame:
    """``project, path, ord`` and the element of an array computed from the text.

    The array is unfolded as an expression: of a column that is unfolded the optimizer
    filters the empty ones first, which computes it three times."""
    content = F.col("content")
    items = array(content)
    if "Go" in languages:
        items = let(golang.code(content), lambda c: F.when(golang.parses(c), array(c)))
    return files.filter(F.col("language").isin(*languages)).select(
        "project", "path", F.posexplode(items).alias("ord", "item")
    )


def _functions(df: DataFrame) -> DataFrame:
    return df.select(
        "project", "path", "ord", F.col("item.name"), F.col("item.line"), F.col("item.exported")
    )


def _types(df: DataFrame) -> DataFrame:
    return df.select(
        "project", "path", "ord",
        F.col("item.name"), F.col("item.kind"), F.col("item.line"), F.col("item.exported"),
    )


def _routes(df: DataFrame) -> DataFrame:
    return df.select(
        "project", "path", "ord",
        F.col("item.method"), F.col("item.path").alias("route"), F.col("item.handler"),
        F.col("item.line"),
    )


def _strings(df: DataFrame, name: str) -> DataFrame:
    return df.select("project", "path", "ord", F.col("item").alias(name))


def js_imports(files: DataFrame) -> DataFrame:
    return _strings(_exploded(files, JS, javascript.imports), "import")


def js_exports(files: DataFrame) -> DataFrame:
    return _strings(_exploded(files, JS, javascript.exports), "export")


def _js_symbols(files: DataFrame) -> DataFrame:
    code = files.filter(F.col("language").isin(*JS)).select(
        "project",
        "path",
        F.col("content").alias("code"),
        javascript.exported_tokens(F.col("content")).alias("tokens"),
    )
    return code.select(
        "project",
        "path",
        javascript.functions(F.col("code"), F.col("tokens")).alias("functions"),
        javascript.types(F.col("code"), F.col("tokens")).alias("types"),
    )


def js_functions(files: DataFrame) -> DataFrame:
    found = _exploded(files, JS, lambda c: javascript.functions(c, javascript.exported_tokens(c)))
    return _functions(found).drop("exported")


def js_types(files: DataFrame) -> DataFrame:
    found = _exploded(files, JS, lambda c: javascript.types(c, javascript.exported_tokens(c)))
    return _types(found).drop("exported")


def js_routes(files: DataFrame) -> DataFrame:
    return _routes(_exploded(files, JS, javascript.routes))


def js_exported_flag(files: DataFrame) -> DataFrame:
    """Every JavaScript/TypeScript symbol with whether an export line names it."""
    flag = "array<struct<kind:string,name:string,line:int,exported:boolean>>"
    functions = F.transform(
        "functions",
        lambda f: F.struct(F.lit("function").alias("kind"), f["name"], f["line"], f["exported"]),
    )
    types = F.transform("types", lambda t: F.struct(t["kind"], t["name"], t["line"], t["exported"]))
    return _js_symbols(files).select(
        "project", "path", F.inline(F.concat(functions.cast(flag), types.cast(flag)))
    )


def py_imports(files: DataFrame) -> DataFrame:
    return _strings(_exploded(files, ("Python",), python.imports), "import")


def py_functions(files: DataFrame) -> DataFrame:
    return _functions(_exploded(files, ("Python",), python.functions))


def py_routes(files: DataFrame) -> DataFrame:
    return _routes(_exploded(files, ("Python",), python.routes))


def py_classes(files: DataFrame) -> DataFrame:
    return _types(_exploded(files, ("Python",), python.types))


def py_exports(files: DataFrame) -> DataFrame:
    return _strings(
        _exploded(
            files, ("Python",), lambda c: python.exports(c, python.functions(c), python.types(c))
        ),
        "export",
    )


def dart_imports(files: DataFrame) -> DataFrame:
    return _strings(_exploded(files, ("Dart",), dart.imports), "import")


def dart_functions(files: DataFrame) -> DataFrame:
    return _functions(_exploded(files, ("Dart",), dart.functions))


def dart_types(files: DataFrame) -> DataFrame:
    return _types(_exploded(files, ("Dart",), dart.types))


def dart_exports(files: DataFrame) -> DataFrame:
    return _strings(
        _exploded(files, ("Dart",), lambda c: dart.exports(c, dart.functions(c), dart.types(c))),
        "export",
    )


def dart_routes(files: DataFrame) -> DataFrame:
    return _routes(_exploded(files, ("Dart",), dart.routes))


def go_imports(files: DataFrame) -> DataFrame:
    return _strings(_exploded(files, ("Go",), golang.imports), "import")


def go_functions(files: DataFrame) -> DataFrame:
    return _exploded(files, ("Go",), golang.functions).select(
        "project", "path", "ord",
        F.col("item.name"), F.col("item.receiver"),
        F.array_join("item.parameters", ", ").alias("parameters"),
        F.array_join("item.returns", ", ").alias("returns"),
        F.col("item.line"), F.col("item.exported"),
    )


def go_types(files: DataFrame) -> DataFrame:
    return _exploded(files, ("Go",), golang.all_types).select(
        "project", "path", "ord",
        F.col("item.name"), F.col("item.kind"),
        F.array_join(F.coalesce("item.fields", F.array().cast("array<string>")), ", ").alias("fields"),
        F.col("item.line"), F.col("item.exported"),
    )


def go_exports(files: DataFrame) -> DataFrame:
    return _strings(
        _exploded(
            files, ("Go",), lambda c: golang.exports(golang.functions(c), golang.all_types(c))
        ),
        "export",
    )


def go_routes(files: DataFrame) -> DataFrame:
    return _routes(_exploded(files, ("Go",), golang.routes))
