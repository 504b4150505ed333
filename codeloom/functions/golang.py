"""Go symbols, read from gofmt-shaped text.

Comments and multi-line raw strings are blanked first (their line breaks stay),
and specs of a grouped ``type ( ... )`` are rewritten to stand alone, so that
column-0 declarations are all that is left to match. :func:`parses` tells whether
brackets, literals and the heads of declarations are those of a Go file.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import patterns as P
from codeloom.functions import symbols as sym
from codeloom.functions.text import captures, hits, let, matches

_ID = r"[\p{L}_][\p{L}\p{Nd}_]*+"
_DEPTH = 8


def _inside(opening: str, closing: str, but: str = "") -> str:
    """What may stand between two brackets of one kind that hold pairs of it, so many deep."""
    run = rf"[^{opening}{closing}{but}]"
    found = run + "*+"
    for _ in range(_DEPTH):
        found = rf"(?:{run}++|{opening}{found}{closing})*+"
    return found


_BALANCED, _SQUARE, _CURLY = _inside(r"\(", r"\)"), _inside(r"\[", r"\]"), _inside(r"\{", r"\}")
_CURLY_LINE = _inside(r"\{", r"\}", r"\n")

# Tiles a file completely: comments, strings, runes, plain runs, single leftovers.
_TOKEN = (
    r"//[^\n]*+|/\*(?s:.*?)\*/|`[^`]*+`|"
    r'"(?:[^"\\\n]|\\.)*+"|'
    r"'(?:[^'\\\n]|\\.)++'|"
    r"""[^/"`']++|[/"`']"""
)
_TYPE_GROUP = r"(?md)^type[\t ]*+\(\n(?s:.*?)^\)|(?s:.+?)(?=^type[\t ]*+\(\n|\z)"

_IMPORT = rf"""(?md)^import{P.S}*+(?:\(([^)]*+)\)|(?:[\p{{L}}\w.]++{P.S}++)?("[^"\n]*+"|`[^`]*+`))"""
_LITERAL = r'"[^"\n]*+"|`[^`]*+`'

_FUNC = (
    rf"(?md)^func{P.S}*+(?:\(([^()]*+)\){P.S}*+)?({_ID})(?:\[{_SQUARE}\])?{P.S}*+\(({_BALANCED})\)"
    rf"[\t ]*+(?:\(({_BALANCED})\)|((?:(?:interface|struct)[\t ]*+\{{{_CURLY}\}}|[^{{}}\n])*+))"
)
_TYPE = (
    rf"(?md)^type[\t ]++({_ID})(?:\[{_inside(r'\[', r'\]', r'\n')}\])?[\t ]++(?:=[\t ]*+)?"
    rf"(?:(struct|interface)[\t ]*+\{{({_CURLY_LINE}\}}|(?s:.*?)^\}})|[^\n]++)"
)
_FIELDS = rf"""(?md)^\t({_ID}(?:,[\t ]*+{_ID})*+)[\t ]++(?=[^\t\n `"])"""
_METHODS = rf"(?md)^\t({_ID})\("

_ARGUMENT = rf"""(?:[^(),"`]++|"(?:[^"\\\n]|\\.)*+"|`[^`]*+`|\({_BALANCED}\))*+"""
_METHOD = "|".join(sorted(P.GO_ROUTE_METHODS, key=len, reverse=True))
# Group 3, the handler, is the last argument where that is a plain name; it is
# read by looking ahead, so that calls nested in the arguments are still found.
_ROUTE_HEAD = (
    rf"(?di)\.{P.S}*+({_METHOD}){P.S}*+\({P.S}*+"
    r"""("(?:[^"\\\n]|\\.)*+"|`[^`]*+`)"""
)
_ROUTE = (
    _ROUTE_HEAD
    + rf"(?={P.S}*+[,)])"
    rf"(?:(?={P.S}*+,(?:{_ARGUMENT},(?!{P.S}*+\)))*+{P.S}*+({_ID}(?:\.{_ID})*+){P.S}*+,?{P.S}*+\))|)"
)


def code(content: Column) -> Column:
    """``content`` without comments, line structure unchanged."""

    def blank(t: Column) -> Column:
        breaks = F.regexp_replace(t, F.lit(r"[^\n]++"), F.lit(""))
        return (
            F.when(t.startswith("//"), "")
            .when(t.startswith("/*"), F.concat(F.lit(" "), breaks))
            .when(t.startswith("`") & t.contains("\n"), F.concat(F.lit("`"), breaks, F.lit("`")))
            .otherwise(t)
        )

    bare = F.when(
        content.contains("//") | content.contains("/*") | content.contains("`"),
        F.array_join(
            F.transform(F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(0)), blank), ""
        ),
    ).otherwise(content)
    return bare


_LITERALS = r'"(?:[^"\\\n]|\\.)*+"|`[^`]*+`|' + r"'(?:[^'\\\n]|\\.)++'"
_PACKAGE = rf"\A[\s\x{{FEFF}}]*+package[\t ]++{_ID}[\t ]*+(?:[;\n]|\z)"
# A line that may end a statement, and then one that begins no declaration.
_STRAY = r"[\p{L}\p{Nd}_)\]}][\t ]*+[;\n]\s*+(?!(?:import|const|var|type|func)(?![\p{L}\p{Nd}_]))[^\s;]"
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


# What a file of the usual shape needs: pairs taken out from within so many times, and
# blocks whose closing bracket is the first of a line.
_PAIRS, _LEVELS = r"(?:\(\)|\[\]|\{\})++", 6
_BLOCK = r"(?md)[({]\n(?s:.*?)^[)}]"


def parses(bare: Column) -> Column:
    """Whether a text without comments (:func:`code`) has the outline of a Go file: a
    package clause, closed literals, brackets that match at any depth, and only
    declarations outside of them. Errors inside a declaration are not looked for.

    Files of the usual shape are told by a few regex passes. For others one pass over
    the brackets keeps the closers that are due, innermost first, and the text outside
    of all brackets.
    """
    # every literal becomes a number, so that quotes that are left have no partner
    plain = F.regexp_replace(bare, F.lit(_LITERALS), F.lit("0"))

    def usual(plain: Column) -> Column:
        left = F.regexp_replace(plain, F.lit(r"[^()\[\]{}]++"), F.lit(""))
        for _ in range(_LEVELS):
            left = F.regexp_replace(left, F.lit(_PAIRS), F.lit(""))
        outside = F.regexp_replace(plain, F.lit(_BLOCK), F.lit(")"))
        return (left == "") & ~outside.rlike(_STRAY)

    def step(state: Column, part: Column) -> Column:
        due, outside = state["due"], state["outside"]
        opened = F.lit(None)
        for bracket, closer in _CLOSERS.items():
            opened = F.when(part == bracket, closer).otherwise(opened)
        closes = part.isin(*_CLOSERS.values())
        # an unmatched closer is due for ever
        now = F.when(opened.isNotNull(), F.concat(opened, due)).when(
            ~closes, due
        ).when(due.startswith(part), F.substr(due, F.lit(2))).otherwise(F.concat(F.lit("!"), due))
        text = F.when(now == "", F.concat(outside, F.when(closes, ")").otherwise(part))).otherwise(outside)
        return F.struct(now.alias("due"), text.alias("outside"))

    def outline(plain: Column) -> Column:
        parts = F.regexp_extract_all(plain, F.lit(r"[()\[\]{}]|[^()\[\]{}]++"), F.lit(0))
        start = F.struct(F.lit("").alias("due"), F.lit("").alias("outside"))
        end = F.aggregate(parts, start, step)
        sound = plain.rlike(_PACKAGE) & ~plain.rlike("[\"'`]") & ~plain.contains("/*")
        exact = (end["due"] == "") & ~end["outside"].rlike(_STRAY)
        return F.array(F.when(~sound, False).when(usual(plain), True).otherwise(exact))

    return F.coalesce(F.element_at(let(plain, outline), 1), F.lit(True))


def ungrouped(bare: Column) -> Column:
    """``bare`` with the specs of each ``type ( ... )`` as declarations of their own."""

    def lift(part: Column) -> Column:
        shallow = F.regexp_replace(part, F.lit(r"(?md)^\t"), F.lit(""))
        return F.when(
            part.rlike(r"^type[\t ]*+\("),
            F.regexp_replace(shallow, F.lit(r"(?md)^(?=[\p{L}_])(?!type[\t ]*+\()"), F.lit("type ")),
        ).otherwise(part)

    return F.when(
        bare.rlike(r"(?md)^type[\t ]*+\(\n"),
        F.array_join(
            F.transform(F.regexp_extract_all(bare, F.lit(_TYPE_GROUP), F.lit(0)), lift), ""
        ),
    ).otherwise(bare)


def exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def type_text(text: Column) -> Column:
    """The short form of one type expression; shapes without one are ``unknown``."""
    flat = F.regexp_replace(text, F.lit(rf"interface ?\{{{_CURLY}\}}"), F.lit("interface{}"))
    flat = F.regexp_replace(flat, F.lit(rf"(?<![\p{{L}}\p{{Nd}}_])\[{_SQUARE}\]"), F.lit("[]"))
    prefix = rf"^((?:\*|\.\.\.|\[\]|map\[(?:\*|\[\])*+{_ID}(?:\.{_ID}|\{{\}})?+\])*+)"

    def short(flat: Column) -> Column:
        return F.transform(
            F.array(F.regexp_extract(flat, prefix, 1)),
            lambda head: F.concat(head, _plain_or_unknown(F.substr(flat, F.length(head) + 1))),
        )

    common = text.rlike(rf"^(?:\*|\[\]|\.\.\.)*+{_ID}(?:\.{_ID})?+\z") & ~text.rlike(
        r"(?:func|struct|chan)\z"
    )
    return F.when(common, text).otherwise(F.element_at(let(flat, short), 1))


def _plain_or_unknown(rest: Column) -> Column:
    plain = rest.rlike(rf"^(?:{_ID}(?:\.{_ID})?+|interface\{{\}})\z")
    return F.when(plain & ~rest.isin("func", "struct", "chan"), rest).otherwise("unknown")


def group_types(params: Column) -> Column:
    """One type per parameter group: ``a, b int`` is one ``int``."""
    piece = rf"(?:[^,()\[\]{{}}]++|\({_BALANCED}\)|\[{_SQUARE}\]|\{{{_CURLY}\}})++"
    one_line = F.regexp_replace(params, F.lit(P.S + "++"), F.lit(" "))
    pieces = F.filter(
        F.transform(
            F.regexp_extract_all(one_line, F.lit(piece), F.lit(0)), lambda p: F.btrim(p)
        ),
        lambda p: p != "",
    )
    named = rf"^{_ID} (?=[^ ])"

    def is_named(p: Column) -> Column:
        return p.rlike(named) & ~p.rlike(r"^(?:chan|func|map|struct|interface) ")

    def texts(ps: Column) -> Column:
        bare = F.transform(
            F.filter(ps, is_named), lambda p: F.regexp_replace(p, F.lit(named), F.lit(""))
        )
        return F.when(F.size(bare) > 0, bare).otherwise(ps)

    return F.transform(let(pieces, texts, when=params != "", kind="array<string>"), type_text)


def imports(bare: Column) -> Column:
    """Import paths in order, repeats kept."""
    specs = F.transform(
        captures(bare, _IMPORT, ("import",), 0),
        lambda spec: F.transform(
            F.regexp_extract_all(spec, F.lit(_LITERAL), F.lit(0)),
            lambda literal: F.btrim(literal, F.lit('"')),
        ),
    )
    return F.flatten(specs)


def functions(bare: Column) -> Column:
    def build(h: Column) -> Column:
        # receiver, parameters, result list, single result: parsed by one expression
        lists = F.transform(F.array(*[h[f"g{i}"] for i in (1, 3, 4, 5)]), group_types)
        return F.struct(h["line"].alias("line"), h["g2"].alias("name"), lists.alias("lists"))

    def finish(f: Column) -> Column:
        lists = f["lists"]
        return sym.function(
            f["name"],
            f["line"],
            exported(f["name"]),
            receiver=F.get(lists[0], F.lit(0)),
            parameters=lists[1],
            returns=F.concat(lists[2], lists[3]),
        )

    return F.transform(F.transform(hits(bare, _FUNC, ("func",), 1, 2, 3, 4, 5), build), finish)


def types(flat: Column) -> Column:
    def build(h: Column) -> Column:
        name, kind, body = h["g1"], h["g2"], h["g3"]
        lines = F.when(body.contains("\n"), body).otherwise(
            F.regexp_replace(
                F.regexp_replace(body, F.lit(rf"\{{{_CURLY}\}}"), F.lit("{}")), F.lit(r"(?:^|;)[\t ]*+"), F.lit("\n\t")
            )
        )
        members = F.when(
            kind == "struct",
            F.flatten(
                F.transform(
                    F.regexp_extract_all(lines, F.lit(_FIELDS), F.lit(1)),
                    lambda names: F.split(names, r",[\t ]*"),
                )
            ),
        ).when(kind == "interface", F.regexp_extract_all(lines, F.lit(_METHODS), F.lit(1)))
        return sym.type_(
            name, F.when(kind == "", "alias").otherwise(kind), h["line"], exported(name), members
        )

    return F.transform(hits(flat, _TYPE, ("type",), 1, 2, 3), build)


def all_types(bare: Column) -> Column:
    """Types that stand alone or in groups; the text is ungrouped once."""
    return let(ungrouped(bare), types, when=bare.contains("type"))


def exports(functions: Column, types: Column) -> Column:
    """Exported functions (with their receiver) and types, in declaration order."""
    fns = F.transform(
        F.filter(functions, lambda f: f["exported"]),
        lambda f: F.struct(
            f["line"].alias("line"), F.concat_ws(".", f["receiver"], f["name"]).alias("name")
        ),
    )
    tps = F.transform(
        F.filter(types, lambda t: t["exported"]),
        lambda t: F.struct(t["line"].alias("line"), t["name"].alias("name")),
    )
    return F.transform(F.array_sort(F.concat(fns, tps)), lambda s: s["name"])


def _without_raw_strings(bare: Column) -> Column:
    """``bare`` with raw strings emptied, but for those that are a call's first argument:
    code inside a string is no call."""
    opens = rf"(?i)\.{P.S}*+(?:{_METHOD}){P.S}*+\({P.S}*+\z"

    def emptied(t: Column) -> Column:
        breaks = F.regexp_replace(t, F.lit(r"[^\n]++"), F.lit(""))
        return F.concat(F.lit("`"), breaks, F.lit("`"))

    def mask(tokens: Column) -> Column:
        return F.transform(
            tokens,
            lambda t, i: F.when(
                t.startswith("`") & ~F.coalesce(F.get(tokens, i - 1), F.lit("")).rlike(opens),
                emptied(t),
            ).otherwise(t),
        )

    found = F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(0))
    masked = F.array_join(let(found, mask, kind="array<string>"), "")
    return F.when(bare.contains("`"), masked).otherwise(bare)


# A route call whose receiver is no plain name on its own line.
_CHAINED = rf"(?di)(?:[)\]}}\"`]{P.S}*+\.{P.S}*+|\.{P.S}*\n{P.S}*+)(?:{_METHOD}){P.S}*+\("
# Tiles a text: route heads (groups as in ``_ROUTE``), literals, words, space, the rest.
_CHAIN_TOKEN = (
    rf"{_ROUTE}|{_LITERALS}|[\p{{L}}\p{{Nd}}_]++|\s++|[()\[\]{{}}.]|[^()\[\]{{}}.\s\p{{L}}\p{{Nd}}_\"`']++|[\"`']"
)
# Tiles a text: declarations and the statements of their bodies, which no chain leaves.
_STATEMENT = r"(?md)(?:\A(?s:.)|^\t?[^\s)}\]])(?s:.*?)(?=^\t?[^\s)}\]]|\z)"


def _chained_routes(text: Column, line: Column) -> Column:
    """Routes in a statement that starts at ``line``, of calls that may be links of one
    chain: each on the line where its chain starts, the last link of a chain first, and
    what stands in arguments behind the chain.

    One pass keeps the start of the operand that is being read (its line and token number
    in one number, null between operands) and those that the open brackets belong to, so
    that a closing bracket takes up its own again.
    """
    fields = ("text", "method", "path", "handler")
    parts = F.zip_with(
        F.zip_with(
            *(F.regexp_extract_all(text, F.lit(_CHAIN_TOKEN), F.lit(i)) for i in (0, 1)),
            lambda t, m: F.struct(t.alias("text"), m.alias("method")),
        ),
        F.zip_with(
            *(F.regexp_extract_all(text, F.lit(_CHAIN_TOKEN), F.lit(i)) for i in (2, 3)),
            lambda p, h: F.struct(p.alias("path"), h.alias("handler")),
        ),
        lambda a, b: F.struct(*[(a if f in fields[:2] else b)[f].alias(f) for f in fields]),
    )
    none = F.lit(None).cast("bigint")
    start = F.struct(
        line.cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("at"), none.alias("operand"),
        F.lit(False).alias("dot"), F.array().cast("array<bigint>").alias("open"), F.lit("").alias("starts"),
    )

    def step(s: Column, part: Column) -> Column:
        text = part["text"]
        is_route = part["method"] != ""
        breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        here = F.coalesce(s["operand"], s["line"] * F.lit(2**32) + s["at"])
        opens, closes = is_route | text.isin("(", "[", "{"), text.isin(")", "]", "}")
        # a word or a literal goes on behind a dot or a bracket only
        word = text.rlike("^[\\p{L}\\p{Nd}_\"`']")
        space = text.rlike(r"^\s")
        operand = (
            F.when(opens, none).when(closes, F.get(s["open"], F.lit(0))).when(word, here)
            .when(text == ".", s["operand"]).when(space & s["dot"], s["operand"])
        )
        stack = F.when(opens, F.concat(F.array(here), s["open"])).when(
            closes, F.slice(s["open"], 2, 2**30)
        ).otherwise(s["open"])
        # as text, since a state is copied at every step
        starts = F.when(is_route, F.concat(s["starts"], here.cast("string"), F.lit(" "))).otherwise(s["starts"])
        return F.struct(
            (s["line"] + breaks).alias("line"), (s["at"] + 1).alias("at"), operand.alias("operand"),
            ((text == ".") | (space & s["dot"])).alias("dot"), stack.alias("open"), starts.alias("starts"),
        )

    def ordered(parts: Column) -> Column:
        starts = F.split(F.aggregate(parts, start, step, lambda s: s["starts"]), " ")
        heads = F.transform(
            F.filter(parts, lambda p: p["method"] != ""),
            lambda p, i: F.struct((-i).alias("back"), *[p[f].alias(f) for f in fields[1:]]),
        )
        links = F.zip_with(
            F.slice(starts, 1, F.size(heads)), heads,
            lambda at, h: F.struct(at.cast("bigint").alias("start"), h.alias("head")),
        )
        return F.transform(
            F.array_sort(links),
            lambda r: sym.route(
                F.upper(r["head"]["method"]), F.btrim(r["head"]["path"], F.lit('"')), r["head"]["handler"],
                F.shiftright(r["start"], 32),
            ),
        )

    kind = f"array<struct<{','.join(f + ':string' for f in fields)}>>"
    return let(parts, ordered, kind=kind)


def routes(bare: Column) -> Column:
    """Route calls in the order of the syntax tree: outer calls before those in their
    arguments, and of a chain of calls the last link first, all on the chain's first line."""

    def plain(text: Column, first: Column) -> Column:
        return F.transform(
            hits(text, _ROUTE, ("(",), 1, 2, 3),
            lambda h: sym.route(
                F.upper(h["g1"]), F.btrim(h["g2"], F.lit('"')), h["g3"], h["line"] + first - 1
            ),
        )

    def one(h: Column) -> Column:
        chained = h["text"].rlike(_CHAINED)
        return F.when(chained, _chained_routes(h["text"], h["line"])).otherwise(plain(h["text"], h["line"]))

    def either(masked: Column) -> Column:
        calls = F.filter(matches(masked, _STATEMENT, ("(",)), lambda h: h["text"].rlike(_ROUTE_HEAD))
        by_statement = F.flatten(F.transform(calls, one))
        return F.when(masked.rlike(_CHAINED), by_statement).otherwise(plain(masked, F.lit(1)))

    # raw strings that are masked make no new head, so a text without one has no routes
    return let(_without_raw_strings(bare), either, when=bare.contains("(") & bare.rlike(_ROUTE_HEAD))
