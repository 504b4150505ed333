"""Regex matches with line numbers, as array columns of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Non-characters that frame each match; text that already holds one gets a
# third instead, which every pattern treats the same way.
_MARK, _NEXT, _STAND_IN = "\ufdd0", "\ufdd2", "\ufdd3"
_ALL = 2**30


def let(
    value: Column,
    body: Callable[[Column], Column],
    when: Column | None = None,
    kind: str = "string",
) -> Column:
    """``body(value)``, an array column, with ``value`` evaluated once.

    With ``when``, rows that fail the condition get an empty array and never
    evaluate ``value``; ``kind`` is the type of ``value``.
    """
    bound = F.array(value)
    if when is not None:
        bound = F.when(when, bound).otherwise(F.array().cast(f"array<{kind}>"))
    return F.flatten(F.transform(bound, body))


def contains_any(content: Column, needles: tuple[str, ...]) -> Column:
    cond = content.contains(needles[0])
    for needle in needles[1:]:
        cond = cond | content.contains(needle)
    return cond


# Up to so many matches of a text are numbered by adding up the line breaks before each.
_FEW = 16


def _framed(
    content: Column,
    pattern: str,
    needles: tuple[str, ...],
    inside: str,
    after: str,
    element: Callable[[Column, Column], Column],
) -> Column:
    """``element(line, framed text)`` of each match of ``pattern``.

    One regex pass puts ``inside`` between two frame marks where a match starts and
    ``after`` behind them. A plain split at the marks leaves the framed texts at odd places
    and what lies between at even ones; a match's line comes from the line breaks before it.
    Of many matches the lines are numbered instead, so the cost is linear in the text.
    ``needles`` are literals, one of which every match contains: other files skip the regex.
    """
    safe = F.when(
        contains_any(content, (_MARK, _NEXT)), F.translate(content, _MARK + _NEXT, _STAND_IN * 2)
    ).otherwise(content)
    marked = F.regexp_replace(
        safe, F.lit(pattern), F.lit(f"{_MARK}{inside}{_MARK}{after}")
    )

    def breaks(text: Column) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))

    def added(pieces: Column) -> Column:
        # what is framed counts here, unless it is repeated behind the frame
        def before(piece: Column, i: Column) -> Column:
            own = breaks(piece)
            return F.when(i % 2 == 0, own).otherwise(F.lit(0)) if after else own

        return let(
            F.transform(F.slice(pieces, 1, F.size(pieces) - 1), before),
            lambda counts: F.transform(
                F.sequence(F.lit(1), F.size(counts), F.lit(2)),
                lambda n: F.aggregate(F.slice(counts, 1, n), F.lit(1), lambda a, c: a + c),
            ),
            kind="array<int>",
        )

    def numbered(pieces: Column) -> Column:
        # one mark where a match starts, and each line break once
        def bared(piece: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, piece).otherwise(F.lit(_MARK) if after else F.concat(F.lit(_MARK), piece))

        bare = F.array_join(F.transform(pieces, bared), "")
        return F.flatten(
            F.filter(
                F.transform(
                    F.split(bare, "\n"),
                    lambda line, i: F.when(
                        line.contains(_MARK),
                        F.array_repeat(
                            i + 1, F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit("")))
                        ),
                    ),
                ),
                lambda a: a.isNotNull(),
            )
        )

    def read(m: Column) -> Column:
        def found(pieces: Column) -> Column:
            lines = F.when(F.size(pieces) <= 2 * _FEW + 1, added(pieces)).otherwise(numbered(pieces))
            return F.zip_with(lines, F.filter(pieces, lambda _, i: i % 2 == 1), element)

        some = F.filter(F.array(F.split(m, _MARK)), lambda p: F.size(p) > 1)
        return F.flatten(F.transform(some, found))

    return let(marked, read, when=contains_any(content, needles))


def hits(content: Column, pattern: str, needles: tuple[str, ...], *groups: int) -> Column:
    """``array<struct<line int, g1 string, ...>>``: captures of each match, empty where
    a group takes no part in it."""
    inside = _NEXT.join(f"${g}" for g in groups)

    def element(line: Column, text: Column) -> Column:
        if len(groups) == 1:
            return F.struct(line.alias("line"), text.alias("g1"))
        return F.element_at(
            F.transform(
                F.array(F.split(text, _NEXT)),
                lambda parts: F.struct(
                    line.alias("line"), *[parts[i].alias(f"g{i + 1}") for i in range(len(groups))]
                ),
            ),
            1,
        )

    return _framed(content, pattern, needles, inside, "$0", element)


def matches(
    content: Column, pattern: str, needles: tuple[str, ...], ahead: int | None = None
) -> Column:
    """``array<struct<line int, text string>>``: the whole text of each match, to
    read captures from that may span lines. With ``ahead``, field ``ahead`` is a
    capture made by looking ahead of the match, inside one line."""

    def element(line: Column, text: Column) -> Column:
        if ahead is None:
            return F.struct(line.alias("line"), text.alias("text"))
        return F.struct(
            line.alias("line"),
            F.substring_index(text, _NEXT, 1).alias("text"),
            F.substring_index(text, _NEXT, -1).alias("ahead"),
        )

    inside = "$0" if ahead is None else f"$0{_NEXT}${ahead}"
    return _framed(content, pattern, needles, inside, "", element)


def group(h: Column, pattern: str, index: int) -> Column:
    """Capture ``index`` of one element of :func:`matches`."""
    return F.regexp_extract(h["text"], pattern, index)


def captures(content: Column, pattern: str, needles: tuple[str, ...], index: int = 1) -> Column:
    """``array<string>``: one capture of every match, where lines do not matter."""
    return F.when(
        contains_any(content, needles), F.regexp_extract_all(content, F.lit(pattern), F.lit(index))
    ).otherwise(F.array().cast("array<string>"))
