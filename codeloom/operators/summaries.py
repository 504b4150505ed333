"""Batch side of model-written summaries: prompts, requests, usage, cost, choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.patterns import WHITE_SPACE
from codeloom.operators import report, skew
from codeloom.operators.graph import graph_summary, relationship_lines

# Provider -> USD per million input and output tokens.
PRICES = {
    "claude": (3.00, 15.00),
    "openai": (2.50, 10.00),
    "gemini": (1.25, 5.00),
    "deepseek": (0.14, 0.28),
    "mistral": (2.00, 6.00),
    "ollama": (0.00, 0.00),
}

# Provider -> default model, in order of preference.
MODELS = {
    "claude": "claude-sonnet-4-5-20250514",
    "openai": "gpt-4o",
    "gemini": "gemini-2.5-pro",
    "deepseek": "deepseek-chat",
    "mistral": "mistral-large-latest",
    "ollama": "llama3",
}

# The request's token limit and the wording of the prompt.
MAX_TOKENS = 4096
INSTRUCTIONS = """Generate a clear, concise architecture overview with these sections:
1. Overview (what this project does, 2-3 sentences)
2. Architecture (how it's structured, main layers)
3. Entry Points (where to start reading the code)
4. Data Flow (how data moves through the system)
5. Key Dependencies (main external libraries and their purpose)

Be specific, technical, and helpful to a developer who is new to this codebase.
Output language: {language}
"""

# The texts between the parts of the prompt.
OPENING = ('You are analyzing a software project called "', '".\nBelow is the structural analysis of the codebase:\n\n')
FACTS = ("Files analyzed: %d\n", "Languages: %s\n")
ENTRIES = ("Entry points: ", "\n")
GRAPH = (
    "\nFile structure and relationships:\nGraph summary:\n",
    "  Modules: %d\n", "  Types: %d\n", "  API routes: %d\n", "  Dependencies: %d\n\n",
    "Key relationships:\n",
)
FUNCTIONS = "\n\nKey functions and modules:\n"


_UNPRINTED = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"
# Escapes of control characters that have a letter.
_ESCAPES = {7: "a", 8: "b", 9: "t", 10: "n", 11: "v", 12: "f", 13: "r"}


def quoted(text: Column) -> Column:
    """The inside of a double-quoted literal: quote and backslash are escaped, and so are
    characters that are not printed (all but letters, marks, numbers, punctuation,
    symbols and the plain space)."""
    plain = text
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"')):
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code < 0x80, F.format_string("\\x%02x", code)).when(
            code < 0x10000, F.format_string("\\u%04x", code)
        ).otherwise(F.format_string("\\U%08x", code))
        for number, letter in _ESCAPES.items():
            out = F.when(code == number, f"\\{letter}").otherwise(out)
        return F.when(c.rlike(_UNPRINTED), out).otherwise(c)

    return F.when(
        text.rlike(_UNPRINTED), F.array_join(F.transform(F.split(plain, ""), escape), "")
    ).otherwise(plain)


def build_prompts(nodes: DataFrame, edges: DataFrame, language: str = "en") -> DataFrame:
    """``project, section, file, seq, text``: the prompt of each project in pieces.

    Ordered by ``section, file, seq`` and joined without a separator they are the
    prompt, whole for a project of any size; none is ever put together in one row.
    """
    totals = report.project_totals(nodes, edges)
    counts = graph_summary(nodes, edges).withColumnRenamed("types", "exported")
    per_language = report.language_counts(nodes)
    langs = per_language.groupBy("project").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("language", "files"))),
                lambda l: F.format_string("%s (%d files)", l["language"], l["files"]),
            ),
            ", ",
        ).alias("langs")
    )
    name = quoted(F.col("project"))
    has_entry = F.col("first_prompt_entry").isNotNull()
    opening = F.concat(
        report.block(
            0,
            F.concat(
                F.lit(OPENING[0]), name, F.lit(OPENING[1]),
                F.format_string(FACTS[0], "files"),
                F.format_string(FACTS[1], "langs"),
            ),
        ),
        F.when(has_entry, report.block(1, ENTRIES[0])).otherwise(
            F.slice(report.block(1, ""), 1, 0)
        ),
        F.when(has_entry, report.block(3, ENTRIES[1])).otherwise(F.slice(report.block(3, ""), 1, 0)),
        report.block(
            4,
            F.concat(
                F.lit(GRAPH[0]),
                F.format_string(GRAPH[1], "modules"),
                F.format_string(GRAPH[2], "exported"),
                F.format_string(GRAPH[3], "api_routes"),
                F.format_string(GRAPH[4], "dependencies"),
                F.lit(GRAPH[5]),
            ),
        ),
        report.block(6, FUNCTIONS),
        report.block(8, "\n" + INSTRUCTIONS.format(language=language)),
    )
    heads = (
        totals.join(counts, "project").join(langs, "project").select("project", F.inline(opening))
    )
    first = totals.select("project", "first_prompt_entry")
    entries = skew.lookup(
        report.entry_points_prompt(nodes), first, ["project"], ["path"], how="inner"
    )
    separator = F.when(F.col("path") == F.col("first_prompt_entry"), "").otherwise(", ")
    functions = nodes.select("project", "path", F.posexplode("functions").alias("ord", "f")).filter(
        "f.exported"
    )
    body = (
        report.rows(entries, 2, "path", None, F.concat(separator, F.col("path")))
        .unionByName(
            report.rows(
                relationship_lines(edges), 5, "from_path", "ord", F.concat("text", F.lit("\n"))
            )
        )
        .unionByName(
            report.rows(functions, 7, "path", "ord", F.format_string("- %s: %s()\n", "path", "f.name"))
        )
    )
    return heads.select(*report.LINE).unionByName(body)


# What stands before and behind the prompt in each provider's request.
def _frame(provider: str, model: str) -> tuple[str, str]:
    if provider == "gemini":
        return '{"contents":[{"parts":[{"text":"', f'"}}]}}],"generationConfig":{{"maxOutputTokens":{MAX_TOKENS}}}}}'
    if provider == "ollama":
        return f'{{"model":"{model}","prompt":"', '","stream":false}'
    return f'{{"max_tokens":{MAX_TOKENS},"messages":[{{"content":"', f'","role":"user"}}],"model":"{model}"}}'


def escaped(text: Column) -> Column:
    """``text`` as it stands between the quotes of a JSON string; escaping goes
    character by character, so pieces may be escaped on their own."""
    quoted = F.to_json(F.struct(text.alias("t")))
    return F.substr(quoted, F.lit(7), F.length(quoted) - 8)


def request_payloads(prompts: DataFrame, providers: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """``project, provider, model, section, file, seq, text``: request bodies in pieces.

    Ordered by ``section, file, seq`` and joined without a separator, the pieces of a
    project and provider are one JSON body. The providers are a fixed short list,
    unfolded per piece.
    """
    frames = {p: _frame(p, MODELS[p]) for p in providers}
    wanted = F.array(
        *[F.struct(F.lit(p).alias("provider"), F.lit(MODELS[p]).alias("model")) for p in providers]
    )
    ends = F.array(
        *[
            F.struct(
                F.lit(p).alias("provider"), F.lit(MODELS[p]).alias("model"),
                F.lit(section).alias("section"), F.lit("").alias("file"), F.lit(0).alias("seq"),
                F.lit(text).alias("text"),
            )
            for p, frame in frames.items()
            for section, text in zip((-1, 9), frame)
        ]
    )
    columns = ("project", "provider", "model", "section", "file", "seq", "text")
    middle = prompts.select(
        "project", "section", "file", "seq", escaped(F.col("text")).alias("text"), F.inline(wanted)
    )
    # every prompt has exactly one opening piece
    outer = prompts.filter((F.col("section") == 0) & (F.col("seq") == 0)).select("project", F.inline(ends))
    return middle.select(*columns).unionByName(outer.select(*columns))


_RESPONSE = {
    "claude": "content array<struct<text string>>, usage struct<input_tokens bigint, output_tokens bigint>",
    "openai": (
        "choices array<struct<message struct<content string>>>, "
        "usage struct<prompt_tokens bigint, completion_tokens bigint, total_tokens bigint>"
    ),
    "gemini": (
        "candidates array<struct<content struct<parts array<struct<text string>>>>>, "
        "usageMetadata struct<promptTokenCount bigint, candidatesTokenCount bigint, totalTokenCount bigint>"
    ),
    "ollama": "response string, prompt_eval_count bigint, eval_count bigint",
}


# A member's name, a string of another kind, or what lies between.
_NAME = r'"(?:[^"\\]|\\.)*+"\s*+:'
_UPPER_NAME = r'"[^"\\]*[A-Z][^"\\]*"\s*+:'


def _folded_names(raw: Column) -> Column:
    """``raw`` with the names of members in lower case; texts stay as they are."""
    parts = F.regexp_extract_all(raw, F.lit(rf'(?s){_NAME}|"(?:[^"\\]|\\.)*+"|[^"]++|"'), F.lit(0))
    name = rf"(?s)\A{_NAME}\z"
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(name), F.lower(p)).otherwise(p)), "")


def normalize_usage(responses: DataFrame) -> DataFrame:
    """Raw responses as ``text``, token counts and ``error``.

    ``responses`` has ``project, provider, model, response, error``. A call that
    failed, text that is not the provider's JSON (one object, nothing behind it, whole
    numbers of tokens) and an empty answer all give an ``error``, with no text and no
    tokens. Names of members are read in any case, and of repeated ones the last counts.
    """
    provider, raw = F.col("provider"), F.col("response")
    folded = F.when(raw.rlike(_UPPER_NAME), _folded_names(raw)).otherwise(raw)
    shape = F.when(provider.isin("claude", "gemini", "ollama"), provider).when(
        provider.isin("openai", "mistral", "deepseek"), F.lit("openai")
    )
    read = responses.withColumn("shape", shape)
    for name, schema in _RESPONSE.items():
        read = read.withColumn(
            name,
            F.when(
                F.col("shape") == name,
                F.from_json(
                    folded, f"{schema.lower()}, _unread string",
                    {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"},
                ),
            ),
        )

    def field(claude: str, openai: str, gemini: str, ollama: str, default: str) -> Column:
        found = F.lit(None)
        for name, path in (("ollama", ollama), ("gemini", gemini), ("openai", openai), ("claude", claude)):
            value = F.expr(f"coalesce({path.lower()}, {default})")
            found = F.when(F.col("shape") == name, value).otherwise(found)
        return found

    text = field(
        "get(claude.content, 0).text",
        "get(openai.choices, 0).message.content",
        "get(get(gemini.candidates, 0).content.parts, 0).text",
        "ollama.response",
        "''",
    )
    spent = field(
        "claude.usage.input_tokens", "openai.usage.prompt_tokens",
        "gemini.usageMetadata.promptTokenCount", "ollama.prompt_eval_count", "0L",
    )
    made = field(
        "claude.usage.output_tokens", "openai.usage.completion_tokens",
        "gemini.usageMetadata.candidatesTokenCount", "ollama.eval_count", "0L",
    )
    total = field(
        "coalesce(claude.usage.input_tokens, 0L) + coalesce(claude.usage.output_tokens, 0L)",
        "openai.usage.total_tokens",
        "gemini.usageMetadata.totalTokenCount",
        "coalesce(ollama.prompt_eval_count, 0L) + coalesce(ollama.eval_count, 0L)",
        "0L",
    )
    answers = field(
        "size(claude.content)", "size(openai.choices)",
        "size(get(gemini.candidates, 0).content.parts)", "length(ollama.response)", "0",
    )
    # in an array before an end mark, one object and nothing else is the first of two
    marked = F.from_json(
        F.concat(F.lit("["), raw, F.lit(',"end"]')), "array<string>",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"},
    )
    whole = (F.size(marked) == 2) & (F.get(marked, F.lit(1)) == "end")
    typed = F.coalesce(*[F.col(f"{name}._unread") for name in _RESPONSE]).isNull()
    parsed = whole & typed & raw.rlike(r"^\s*\{")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("shape").isNull(), "unknown provider")
        .when(~F.coalesce(parsed, F.lit(False)), "unreadable response")
        .when(answers <= 0, "empty response")
    )
    kept = [c for c in responses.columns if c not in ("response", "error")]
    checked = read.select(
        *kept,
        problem.alias("error"),
        text.alias("text"),
        spent.alias("input_tokens"),
        made.alias("output_tokens"),
        total.alias("total_tokens"),
    )
    for name in ("text", "input_tokens", "output_tokens", "total_tokens"):
        checked = checked.withColumn(name, F.when(F.col("error").isNull(), F.col(name)))
    return checked


def prices(spark: SparkSession) -> DataFrame:
    rows = [(p, float(i), float(o)) for p, (i, o) in PRICES.items()]
    return spark.createDataFrame(rows, "provider string, usd_in double, usd_out double")


def usage_cost(usage: DataFrame) -> DataFrame:
    """Add ``cost`` in USD; unknown providers cost 0. The price table is a
    constant of six rows."""
    cost = (
        F.col("input_tokens") * F.col("usd_in") + F.col("output_tokens") * F.col("usd_out")
    ) / F.lit(1_000_000.0)
    return (
        usage.join(F.broadcast(prices(usage.sparkSession)), "provider", "left")
        .withColumn("cost", F.coalesce(cost, F.lit(0.0)))
        .drop("usd_in", "usd_out")
    )


def _four_decimals(value: Column) -> Column:
    """``value`` (not negative) rounded as its exact binary value asks for.

    Ties in the decimal text are common among costs but are no ties in binary,
    so the product with 10,000 is taken with its rounding error (exact, by
    splitting the factor), and that error decides.
    """
    scale = F.lit(10_000.0)
    split = value * F.lit(134_217_729.0)
    high = split - (split - value)
    low = value - high
    product = value * scale
    error = (high * scale - product) + low * scale
    whole = F.floor(product)
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    # a product rounded up to a whole number may stem from just below it
    units = whole + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(units / 10_000).cast("string"),
        F.lit("."),
        F.lpad((units % 10_000).cast("string"), 4, "0"),
    )


def cost_string(costs: DataFrame) -> DataFrame:
    """Add ``cost_text``; rows without token counts have no usage to report."""
    text = (
        F.when(F.col("input_tokens").isNull(), "N/A")
        .when(F.col("cost") == 0, "Free (local)")
        .otherwise(F.concat(F.lit("$"), _four_decimals(F.col("cost")), F.lit(" ("), "provider", F.lit(")")))
    )
    return costs.withColumn("cost_text", text)


def cost_totals(costs: DataFrame) -> DataFrame:
    return costs.groupBy("project", "provider").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"),
    )


def summary_fallback(
    projects: DataFrame,
    summaries: DataFrame,
    structural: DataFrame,
    primary: str,
    fallback: str = "ollama",
) -> DataFrame:
    """``project, summary, chosen_tier``.

    The primary provider's text counts unless it failed or is blank; the
    fallback's unless it failed; the structural sentence is always there.
    ``summaries`` has one row per project and provider.
    """

    def answers(provider: str, name: str) -> DataFrame:
        return summaries.filter(F.col("provider") == provider).select(
            "project",
            F.when(F.col("error").isNull(), F.col("text")).alias(name),
        )

    usable = F.when(F.btrim("first", F.lit(WHITE_SPACE)) != "", F.col("first"))
    return (
        projects.join(answers(primary, "first"), "project", "left")
        .join(answers(fallback, "second"), "project", "left")
        .join(structural, "project", "left")
        .select(
            "project",
            F.coalesce(usable, "second", "summary").alias("summary"),
            F.when(usable.isNotNull(), "primary")
            .when(F.col("second").isNotNull(), "fallback")
            .otherwise("structural")
            .alias("chosen_tier"),
        )
    )
