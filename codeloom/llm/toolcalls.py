"""Tool calls of conversations: linked, ordered, validated and serialised.

DataFrame functions only. Calls meet their results by a hash join on conversation and
identifier, dependencies are resolved level by level, arguments are checked against
the tools' schemas, and each call becomes one line of canonical JSON.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.skew import lookup
from codeloom.session import new_stage_path, stage

# JSON types by the names that Spark gives to parsed values.
_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
}


@dataclass(frozen=True)
class Param:
    name: str
    type: str
    required: bool = True


@dataclass(frozen=True)
class Tool:
    name: str
    params: tuple[Param, ...]


# A text that goes on behind its JSON value is refused: as an element of an array it
# would make the array have other elements, or none.
def parsed(arguments: Column) -> Column:
    """The arguments as a variant; null where they are no JSON object."""
    inside = F.try_parse_json(F.concat(F.lit("["), arguments, F.lit("]")))
    one = F.get_json_object(F.concat(F.lit("["), arguments, F.lit("]")), "$[1]").isNull()
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    return F.when(inside.isNotNull() & one & is_object, value)


def problems(name: Column, value: Column, tools: tuple[Tool, ...]) -> Column:
    """What is wrong with the arguments, as a sorted array of short codes."""
    given = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    known = F.array(F.lit("unknown_tool"))
    for tool in tools:
        checks = []
        for p in tool.params:
            there = F.array_contains(given, p.name)
            kind = F.schema_of_variant(F.try_variant_get(value, f"$.{p.name}", "variant"))
            wrong = F.when(there & ~F.coalesce(kind.rlike(_TYPES[p.type]), F.lit(False)), f"type:{p.name}")
            checks.append(F.when(~there, f"missing:{p.name}").otherwise(wrong) if p.required else wrong)
        allowed = F.array(*[F.lit(p.name) for p in tool.params]).cast("array<string>")
        extra = F.transform(F.array_except(given, allowed), lambda key: F.concat(F.lit("unexpected:"), key))
        own = F.concat(F.array_compact(F.array(*checks).cast("array<string>")), extra)
        known = F.when(name == tool.name, own).otherwise(known)
    broken = F.array(F.lit("not_an_object"))
    return F.array_sort(F.when(value.isNull(), broken).otherwise(known))


_CALL = ("turn", "name", "arguments", "after")
_RESULT = ("turn", "content")
_KEY = ["conv_id", "call_id"]


def _combined(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """Different rows with the number of their ``copies``, counted before the shuffle."""
    return stage(rows.groupBy(*_KEY, *columns).agg(F.count("*").alias("copies")), name)


def _firsts(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Of each identifier the first row by ``columns`` and how many rows it has (``n``).
    A hot identifier comes as one row a task."""
    least = F.min(F.struct(*columns))
    keyed = rows.filter("conv_id is not null and call_id is not null")
    return keyed.groupBy(*_KEY).agg(least.alias("first"), F.sum("copies").alias("n"))


def _repeats(rows: DataFrame, more: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """The rows behind the ``first`` of their identifier, numbered from 2 by ``columns``;
    ``more`` has the identifiers with several rows.

    Copies of the first row are one row of their own. Rows are cut by ranges, so that
    the repeats of a hot identifier lie in many partitions; each adds what lies before it.
    """
    keyed = rows.filter("conv_id is not null and call_id is not null")
    met = lookup(keyed, more, _KEY, list(columns), "inner")
    again = F.struct(*columns).eqNullSafe(F.col("first"))
    left = met.withColumn("copies", F.col("copies") - again.cast("long")).filter("copies > 0")
    counts = ["n_calls", "n_results"]
    ranged = left.select(*_KEY, *columns, "copies", *counts).repartitionByRange(*_KEY, *columns)
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), name)
    before = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*_KEY, "part").agg(F.count("*").alias("size"))
    offsets = sizes.select(*_KEY, "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy(*_KEY, "part").orderBy(*columns))
    numbered = ranged.withColumn("repeat", own)
    return numbered.join(offsets, [*_KEY, "part"]).select(
        *_KEY, *columns, "copies", *counts, F.lit("duplicate").alias("link"),
        (F.col("repeat") + F.col("offset") + 1).alias("repeat"),
    )


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call and every result once.

    ``calls(conv_id, call_id, turn, name, arguments, after)``, ``results(conv_id,
    call_id, turn, content)``. The first call of a conversation and identifier (by turn,
    name, arguments and dependencies) meets the first result (by turn and content) in one
    row: ``linked``, or ``unanswered`` or ``orphan`` where a side is missing. Each further
    one is a ``duplicate`` row with its ``repeat`` number from 2. Rows without a
    conversation or an identifier are ``unkeyed`` and meet nothing; nulls come first in
    any order. Equal rows that are duplicates or unkeyed are one row with their number as
    ``copies``. ``n_calls`` and ``n_results`` tell how many rows the identifier has.
    """
    calls = _combined(calls, _CALL, "calls")
    results = _combined(results, _RESULT, "results")
    answers = _firsts(results, _RESULT).select(
        F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"),
        F.col("first").alias("result"), F.col("n").alias("n_results"),
    )
    same = (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call"))
    both = (
        _firsts(calls, _CALL).select(*_KEY, F.col("first").alias("call"), F.col("n").alias("n_calls"))
        .hint("shuffle_hash").join(answers, same, "full")
    )
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    met = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"),
        *[F.col(f"call.{c}").alias(c) for c in _CALL],
        F.col("result.turn").alias("result_turn"), F.col("result.content").alias("content"),
        F.col("call").isNotNull().alias("is_call"), one.alias("repeat"), one.alias("copies"),
        F.coalesce("n_calls", no).alias("n_calls"), F.coalesce("n_results", no).alias("n_results"),
        F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered")
        .otherwise("linked").alias("link"),
    )
    met = stage(met, "first-calls")

    def repeated(first: Column, count: str) -> DataFrame:
        return met.filter(F.col(count) > 1).select(*_KEY, first.alias("first"), "n_calls", "n_results")

    def alone(rows: DataFrame, is_call: bool) -> DataFrame:
        n = F.col("copies")
        return rows.filter("conv_id is null or call_id is null").select(
            "*", F.lit(None).cast("long").alias("repeat"), F.lit("unkeyed").alias("link"),
            (n if is_call else no).alias("n_calls"), (no if is_call else n).alias("n_results"),
        )

    first_result = F.struct(F.col("result_turn").alias("turn"), "content")
    more_calls = _repeats(calls, repeated(F.struct(*_CALL), "n_calls"), _CALL, "more-calls")
    more_results = _repeats(results, repeated(first_result, "n_results"), _RESULT, "more-results")
    more_calls = more_calls.unionByName(alone(calls, True))
    more_results = more_results.unionByName(alone(results, False))
    return met.unionByName(
        more_calls.withColumn("is_call", F.lit(True)), allowMissingColumns=True
    ).unionByName(
        more_results.withColumnRenamed("turn", "result_turn").withColumn("is_call", F.lit(False)),
        allowMissingColumns=True,
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of the calls whose dependencies can be resolved.

    ``calls(conv_id, call_id, after)``, a row per identifier. A call without dependencies
    has level 0, another one more than the highest level it depends on; sorting by level
    is a topological order. Each round takes the calls whose last dependency the round
    before has resolved, and is written to the shared folder, where one scan reads all
    rounds; there are as many as the longest chain has calls. Calls in or behind a cycle
    get no row. Dependencies on unknown identifiers do not count.
    """
    spark, folder = calls.sparkSession, new_stage_path(calls.sparkSession, "call-levels")
    needs = (
        calls.select("conv_id", F.col("call_id").alias("by"), F.explode(F.array_distinct("after")).alias("call_id"))
        .join(calls.select(*_KEY), _KEY, "left_semi")
        .select("conv_id", "by", "call_id")
    )
    needs = stage(needs, "call-needs")
    open_ = needs.groupBy("conv_id", F.col("by").alias("call_id")).agg(F.count("*").alias("need"))
    open_ = stage(open_, "call-open")
    key_types = calls.select(*_KEY).schema

    def write(ready: DataFrame, level: int) -> DataFrame:
        ready.select(*_KEY).write.parquet(f"{folder}/level={level}")
        return spark.read.schema(key_types).parquet(f"{folder}/level={level}")

    ready, level = write(calls.join(open_, _KEY, "left_anti"), 0), 0
    while not (open_.isEmpty() or ready.isEmpty()):
        met = (
            needs.join(ready, _KEY, "left_semi")
            .groupBy("conv_id", F.col("by").alias("call_id"))
            .agg(F.count("*").alias("met"))
        )
        counted = stage(
            open_.join(met, _KEY, "left").select(
                *_KEY, (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")
            ),
            "call-counted",
        )
        level += 1
        ready = write(counted.filter("need = 0"), level)
        open_ = counted.filter("need > 0")
    return spark.read.schema(f"{_ddl(key_types)}, level int").parquet(folder)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def tool_calls(calls: DataFrame, results: DataFrame, tools: tuple[Tool, ...]) -> DataFrame:
    """``conv_id, level, turn, call_id, result_turn, link, repeat, copies, n_calls,
    n_results, valid, errors, json``, a row per call or result as :func:`linked` has them.

    Sorted by ``conv_id, level, turn, call_id`` a conversation's calls stand in a
    topological order. ``level`` is null for a result without a call, for a call in or
    behind a cycle (error ``cycle``), and for duplicate and unkeyed calls (errors
    ``duplicate_identifier`` and ``no_identifier``), on which nothing depends. Identifiers
    in ``after`` of other calls that the conversation lacks give
    ``unknown_dependency:<id>``. ``json`` holds the keys in order, nulls left out, and
    arguments with their keys in order as well; those that are no object are kept as
    ``raw_arguments``.
    """
    rows = stage(linked(calls, results), "linked-calls")
    heads = rows.filter("is_call and link in ('linked', 'unanswered')").select(*_KEY, "after")
    wanted = heads.select(*_KEY, F.explode(F.array_distinct("after")).alias("dep"))
    there = heads.select("conv_id", F.col("call_id").alias("dep"))
    lost = (
        wanted.join(there, ["conv_id", "dep"], "left_anti")
        .groupBy(*_KEY)
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown_dependency:"), "dep"))).alias("lost"))
    )
    none = F.array().cast("array<string>")
    link, is_call = F.col("link"), F.col("is_call")
    place = (
        F.when(link == "duplicate", F.array(F.lit("duplicate_identifier")))
        .when(link == "unkeyed", F.array(F.lit("no_identifier")))
        .otherwise(F.concat(F.coalesce("lost", none), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(none)))
    )

    def checked(part: DataFrame) -> DataFrame:
        errors = F.array_sort(F.concat(problems(F.col("name"), F.col("value"), tools), place))
        return part.withColumn("value", parsed(F.col("arguments"))).withColumn(
            "errors", F.when(is_call, errors).otherwise(none)
        )

    # repeats and unkeyed rows need no look-up, so their hot keys are in no shuffle
    single = link.isin("duplicate", "unkeyed")
    placed = rows.filter(~single).join(lost, _KEY, "left").join(levels(heads), _KEY, "left")
    apart = rows.filter(single).select("*", none.alias("lost"), F.lit(None).cast("int").alias("level"))
    line = F.to_json(
        F.struct(
            F.col("value").alias("arguments"), "call_id", "conv_id", "errors", "level", "link", "name",
            F.when(F.col("value").isNull(), F.col("arguments")).alias("raw_arguments"),
            "repeat", F.col("content").alias("result"),
        )
    )
    return checked(placed.unionByName(apart)).select(
        "conv_id", "level", "turn", "call_id", "result_turn", "link", "repeat", "copies", "n_calls", "n_results",
        (is_call & (F.size("errors") == 0)).alias("valid"),
        F.array_join("errors", ";").alias("errors"), line.alias("json"),
    )
