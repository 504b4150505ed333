"""Licence scan of file trees, DataFrame functions only.

A file's licence notice, as a whole and passage by passage, is compared with templates by
the cosine of sparse TF-IDF vectors; a tag that names the licence needs no comparison. A
file without a notice of its own takes the licence of the nearest ancestor directory that
has a licence file, found by joining paths.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.license_forms import FORMS, Template
from codeloom.session import stage

MIN_COSINE = 0.5
# Least cosine of one passage: a line has few words, and half of them are in any notice.
PASSAGE_COSINE = 0.7
# Up to so many matching passages are broadcast to the files they stand in.
BROADCAST_ROWS = 100_000


# Short notices by which licences are known.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("MIT", "Released under the MIT License."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# A line that matches is part of a file's notice; names of licence files.
NOTICE_LINE = r"(?i)licen[cs]e|copyright|redistribution"
LICENSE_FILE = r"(^|/)(LICENSE|LICENCE|COPYING|NOTICE)([.][^/]*)?$"
TOKEN = r"[a-z0-9]+"
# What parts blocks; lines that name who holds the rights; comments; tags.
BLANK = r"\n[ \t\r\n]*\n"
HOLDER_LINE = r"(?i)^\W*(copyright\s+(\(c\)|\x{a9}|[0-9])|\(c\)|\x{a9}|all rights reserved)"
COMMENT_LINE = r"""^\s*(//|/?[*]|#|--|;|%|<!--|dnl\b|rem\b)"""
SENTENCE_END = r"[.;:]\s"
TAG = r"SPDX-License-Identifier:[ \t]*[(]?([A-Za-z0-9]([A-Za-z0-9.+-]*[A-Za-z0-9+])?)"
NO_TAG = ("", "NONE", "NOASSERTION")


def directory(path: Column) -> Column:
    """All of a path before its last ``/``; empty for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def tokens(text: Column) -> Column:
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(folded, F.lit(TOKEN), 0)


def notice(text: Column) -> Column:
    """The lines of a whole text that speak of licences, wherever they stand."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOTICE_LINE))
    return F.when(text.rlike(NOTICE_LINE), F.array_join(lines, "\n")).otherwise("")


def passages(text: Column, licence_file: Column) -> Column:
    """The parts of a whole text that may state a licence, each as its folded words.

    Blocks lie between empty lines. Of a licence file all blocks count and the text as a
    whole, of others the blocks that speak of licences: without lines that name who holds
    the rights, once with all other lines and once with the comments among them. Their
    sentences and lines that speak of licences count on their own.
    """
    found = F.split(text, BLANK)
    found = F.when(licence_file, found).otherwise(F.filter(found, lambda b: b.rlike(NOTICE_LINE)))
    whole = F.when(licence_file, F.array(text)).otherwise(F.array().cast("array<string>"))

    def body(block: Column, comments: bool = False) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda line: ~line.rlike(HOLDER_LINE))
        if comments:
            lines = F.filter(lines, lambda line: line.rlike(COMMENT_LINE))
        return F.array_join(lines, "\n")

    def speaking(block: Column, pattern: str) -> Column:
        return F.filter(F.split(block, pattern), lambda part: part.rlike(NOTICE_LINE))

    def stated(block: Column) -> Column:
        return F.concat(
            F.array(body(block), body(block, comments=True)), speaking(block, "\n"), speaking(block, SENTENCE_END)
        )

    parts = F.concat(F.flatten(F.transform(found, stated)), F.transform(whole, lambda t: body(t)))
    words = F.transform(parts, lambda part: F.array_join(tokens(part), " "))
    return F.filter(F.array_distinct(words), lambda part: part != "")


def tag(text: Column) -> Column:
    """The first identifier of a text's first licence tag, without ``-only``, ``-or-later``
    and ``+``; null without one."""
    found = F.regexp_extract(text, TAG, 1)
    return F.when(~found.isin(*NO_TAG), F.regexp_replace(found, r"(-only|-or-later|[+])$", ""))


def template_terms(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``license, token, tf``: one small row per template and token."""
    values = F.array(
        *[F.struct(F.lit(t.license).alias("license"), F.lit(t.text).alias("text")) for t in templates]
    )
    rows = spark.range(1, numPartitions=1).select(F.explode(values).alias("t")).select("t.license", "t.text")
    return (
        rows.select("license", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("license", "token")
        .agg(F.count("*").alias("tf"))
    )


def matches(notices: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``path, license, cosine`` for each path of ``notices(path, text)``: the template
    with the highest cosine of all the path's notices (ties: the first by name).

    ``idf(t) = ln((1 + n) / (1 + df(t))) + 1`` over all n notices, those of one path
    being one; a token of no template gets the weight of a token seen once. The
    templates bound the tokens that are counted, so that table can be broadcast;
    other tokens only lengthen a notice's vector.
    """
    spark = notices.sparkSession
    terms = template_terms(spark, templates)
    bags = stage(
        notices.select("path", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("path", "token")
        .agg(F.count("*").alias("tf")),
        "license-terms",
    )
    known = bags.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi")
    weight = terms.select("token").distinct().join(
        known.groupBy("token").agg(F.count("*").alias("df")), "token", "left"
    )
    n = float(bags.select(F.count_distinct("path")).first()[0])
    rare = F.log(F.lit((1 + n) / 2)) + 1
    idf = stage(
        weight.select(
            "token", (F.log(F.lit(1 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
        ),
        "license-idf",
    )
    vectors = terms.join(idf, "token").select("license", "token", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = vectors.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_length"))
    vectors = vectors.join(lengths, "license")
    own = (
        bags.join(F.broadcast(idf), "token", "left")
        .select("path", "token", (F.col("tf") * F.coalesce("idf", rare)).alias("weight"))
    )
    size = own.groupBy("path").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dot = (
        own.join(F.broadcast(vectors), "token")
        .groupBy("path", "license", "template_length")
        .agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    )
    scored = dot.join(size, "path").select(
        "path", "license", F.round(F.col("dot") / (F.col("length") * F.col("template_length")), 6).alias("cosine")
    )
    return scored.groupBy("path").agg(_best().alias("b")).select("path", "b.license", "b.cosine")


def _best() -> Column:
    """``license, cosine`` of the highest cosine (ties: the first by name)."""
    return F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), F.col("license")))


def passage_matches(
    parts: DataFrame, templates: tuple[Template, ...] = TEMPLATES, forms: tuple[Template, ...] = FORMS,
    least: float = PASSAGE_COSINE,
) -> DataFrame:
    """``path, license, cosine, form`` of ``parts(path, passages)``: for each path the form
    nearest to one of its passages and the template nearest to one, if at least ``least``.

    Here the templates and forms are the texts over which ``idf(t)`` is counted, as above,
    so a passage's cosine depends on no other file. Passages of many files, such as a
    project's headers, are compared once.
    """
    spark, every = parts.sparkSession, templates + forms
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t.text).alias("text")) for i, t in enumerate(every)])
    terms = (
        spark.range(1, numPartitions=1).select(F.explode(rows).alias("t"))
        .select("t.i", F.explode(tokens(F.col("t.text"))).alias("token"))
        .groupBy("i", "token").agg(F.count("*").alias("tf"))
    )
    rare = F.log(F.lit(1.0 + len(every))) + 1
    idf = terms.groupBy("token").agg((rare - F.log(1.0 + F.count("*"))).alias("idf"))
    weights = terms.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weights.groupBy("i").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = weights.join(lengths, "i").withColumn("w", F.col("w") / F.col("length"))
    # one row per token with its weight in each text, so that a token meets them all at once
    vectors = stage(
        unit.groupBy("token", "idf").agg(*[F.sum(F.when(F.col("i") == i, F.col("w"))).alias(f"w{i}") for i in range(len(every))]),
        "license-forms",
    )
    placed = parts.select("path", F.explode("passages").alias("passage")).withColumn("id", F.unhex(F.md5("passage")))
    own = (
        placed.groupBy("id").agg(F.any_value("passage").alias("passage"))
        .select("id", F.explode(F.split("passage", " ")).alias("token"))
        .groupBy("id", "token").agg(F.count("*").alias("tf"))
        .join(F.broadcast(vectors), "token", "left")
        .withColumn("weight", F.col("tf") * F.coalesce("idf", rare))
    )
    dots = own.groupBy("id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"),
        *[F.sum(F.col("weight") * F.col(f"w{i}")).alias(f"w{i}") for i in range(len(every))],
    )
    cosines = F.array(*[
        F.struct(F.lit(t.license).alias("license"), F.lit(i >= len(templates)).alias("form"),
                 F.round(F.col(f"w{i}") / F.col("length"), 6).alias("cosine"))
        for i, t in enumerate(every)
    ])
    scored = dots.select("id", F.explode(F.filter(cosines, lambda c: c["cosine"] >= least)).alias("c")).select("id", "c.*")
    near = stage(
        scored.groupBy("id", "form").agg(_best().alias("b")).select("id", "form", "b.license", "b.cosine"),
        "license-passages",
    )
    # one header may stand in most files: a join by its id would bring them all to one task
    few = near.count() <= BROADCAST_ROWS
    return (
        placed.select("path", "id").join(F.broadcast(near) if few else near, "id")
        .groupBy("path", "form").agg(_best().alias("b")).select("path", "b.license", "b.cosine", "form")
    )


def scan(
    files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, least: float = MIN_COSINE,
    forms: tuple[Template, ...] = FORMS, least_passage: float = PASSAGE_COSINE,
) -> DataFrame:
    """``path, license, cosine, origin, from_dir`` for each distinct path of ``files(path, text)``.

    ``origin``: ``file`` for a licence file with a match of its own, ``header`` for
    another file with a notice that matches, ``inherited`` with the directory it comes
    from, else ``none`` with null licence and cosine.

    A tag names the licence, with a cosine of 1 (several: the first by name). Else the
    nearer one counts of the template that matches all the path's notices as one and of the
    form (a full text, header or title) that matches one of its passages (ties: the
    template). Where neither does, the template that matches a passage counts. A match of
    all notices has a cosine of at least ``least``, of a passage ``least_passage``.

    Rows of one path are parts of one file; where licence files of one directory differ,
    the best match counts (ties: the first by name). A null text is empty; rows with a
    null path are left out, as they lie nowhere.

    Notices are few against texts, and only they are exploded; directories are
    resolved once each and joined to their files afterwards.
    """
    text, is_file = F.col("text"), F.col("path").rlike(LICENSE_FILE)
    rows = stage(
        files.filter("path is not null").select("path", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("speaks", text.rlike(NOTICE_LINE))
        .select(
            "path", F.when(F.col("speaks"), notice(text)).otherwise("").alias("text"),
            F.when(F.col("speaks"), tag(text)).alias("tag"),
            F.when(F.col("speaks") | is_file, passages(text, is_file)).alias("passages"),
        ),
        "license-notices",
    )
    whole = matches(rows.filter("text != ''"), templates).filter(F.col("cosine") >= least)
    tags = rows.filter("tag is not null").groupBy("path").agg(F.min("tag").alias("license"))
    near = passage_matches(rows.filter("passages is not null"), templates, forms, least_passage)
    found = (
        tags.select("path", "license", F.lit(1.0).alias("cosine"), F.lit(0).alias("rank"), F.lit(0).alias("tie"))
        .union(whole.select("path", "license", "cosine", F.lit(1), F.lit(0)))
        .union(near.select("path", "license", "cosine", F.when(F.col("form"), 1).otherwise(2), F.lit(1)))
    )
    order = F.struct("rank", -F.col("cosine"), "tie")
    found = stage(
        found.groupBy("path").agg(F.min_by(F.struct("license", "cosine"), order).alias("b"))
        .select("path", "b.license", "b.cosine"),
        "license-matches",
    )
    paths = rows.select("path").distinct().select("path", directory(F.col("path")).alias("dir"))
    licensed = (
        found.filter(is_file)
        .select(directory(F.col("path")).alias("ancestor"), "license", "cosine")
        .groupBy("ancestor")
        .agg(_best().alias("l"))
    )
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    ancestors = paths.select("dir").distinct().select("dir", F.explode(depths).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("ancestor")
    )
    nearest = (
        ancestors.join(licensed, "ancestor")
        .groupBy("dir")
        .agg(F.max_by(F.struct("ancestor", "l"), "depth").alias("near"))
    )
    own = F.col("license").isNotNull()
    return (
        paths.join(found, "path", "left")
        .join(nearest, "dir", "left")
        .select(
            "path",
            F.coalesce("license", "near.l.license").alias("license"),
            F.coalesce("cosine", "near.l.cosine").alias("cosine"),
            F.when(own & is_file, "file").when(own, "header")
            .when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
            F.when(~own, F.col("near.ancestor")).alias("from_dir"),
        )
    )
