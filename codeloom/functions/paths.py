"""Path columns: names, directories, joins, ids, ignore globs, languages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import patterns as P


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory of a path below its root; ``.`` for the root itself."""
    length = F.length(path) - F.length(basename(path)) - 1
    return F.when(path.contains("/"), F.substr(path, F.lit(1), length)).otherwise(".")


def extension(path: Column) -> Column:
    name = basename(path)
    return F.when(
        name.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    ).otherwise("")


def language(path: Column) -> Column:
    """Language of a file by its extension; null where no extractor takes it."""
    pairs = [F.lit(text) for pair in P.LANGUAGE_BY_EXTENSION.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def join_clean(directory: Column, relative: Column) -> Column:
    """``directory/relative`` with ``.``, ``..`` and empty parts resolved."""

    def step(stack: Column, part: Column) -> Column:
        top_is_named = (F.size(stack) > 0) & (F.coalesce(F.get(stack, F.size(stack) - 1), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), stack)
            .when((part == "..") & top_is_named, F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(F.concat(stack, F.array(part)))
        )

    parts = F.split(F.concat(directory, F.lit("/"), relative), "/")
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", ".").otherwise(joined)


def node_id(text: Column) -> Column:
    return F.translate(text, "/\\.: -", "______")


def import_stems(path: Column) -> Column:
    """``array<struct<stem, rank>>``: every relative import text, once joined and
    cleaned, that finds this file, with the rank of what the import left off."""
    found = [F.struct(path.alias("stem"), F.lit(0).alias("rank"))]
    for rank, suffix in enumerate(P.IMPORT_SUFFIXES):
        if suffix:
            stem = F.substr(path, F.lit(1), F.length(path) - len(suffix))
            found.append(
                F.when(
                    path.endswith(suffix), F.struct(stem.alias("stem"), F.lit(rank).alias("rank"))
                )
            )
    return F.array_compact(F.array(*found))


def _glob_class(glob: str, start: int) -> tuple[str, int] | None:
    """One ``[...]`` of a glob as regex text and the position after it."""
    body = re.match(r"\[(\^?)((?:(?:\\.|[^\\\]-])(?:-(?:\\.|[^\\\]-]))?)+)\]", glob[start:], re.S)
    if body is None:
        return None
    items = ""
    for low, high in re.findall(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", body[2], re.S):
        low, high = low[-1], (high or low)[-1]
        if low <= high:
            items += f"{re.escape(low)}-{re.escape(high)}"
    if not items:
        return ("[^/]" if body[1] else "(?!)"), start + body.end()
    return f"[{body[1]}{items}]", start + body.end()


def glob_regex(glob: str) -> str | None:
    """A shell glob over one path component as a regex; null for a malformed one."""
    out, i = "", 0
    while i < len(glob):
        char = glob[i]
        if char == "*":
            out += "[^/]*+" if i == len(glob) - 1 else "[^/]*"
        elif char == "?":
            out += "[^/]"
        elif char == "[":
            parsed = _glob_class(glob, i)
            if parsed is None:
                return None
            out, i = out + parsed[0], parsed[1] - 1
        elif char == "\\":
            i += 1
            if i == len(glob):
                return None
            out += re.escape(glob[i])
        else:
            out += re.escape(char)
        i += 1
    return out


def ignored(path: Column, ignore: tuple[str, ...]) -> Column:
    """True where any component of ``path`` equals or matches an ignore entry.

    All entries compile to one alternation, so a path is tested in one pass.
    """
    options = []
    for entry in ignore:
        options.append(re.escape(entry))
        regex = glob_regex(entry)
        if regex is not None and regex != options[-1]:
            options.append(regex)
    if not options:
        return F.lit(False)
    return path.rlike(rf"(?:^|/)(?:{'|'.join(options)})(?:/|\z)")


def report_entry_point(path: Column) -> Column:
    endings = "|".join(re.escape(e) for e in P.REPORT_ENTRY_ENDINGS)
    lowered = F.lower(path)
    return lowered.rlike(rf"(?:{endings})\z") | lowered.contains(P.REPORT_ENTRY_FRAGMENT)


def prompt_entry_point(path: Column) -> Column:
    return F.lower(path).rlike("|".join(re.escape(f) for f in P.PROMPT_ENTRY_FRAGMENTS))
