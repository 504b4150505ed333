"""DuckDB SQL that computes what each query must return, from the given tables.

The SQL rebuilds the corpus itself and applies the patterns in their defining
dialect. Line numbers come from the text between matches, and Go declarations
from a corpus variant whose look-alike lines are blank, so the checks share no
method with the Spark side.
"""

from __future__ import annotations

from codeloom.config import DEFAULT_IGNORE
from codeloom.functions.patterns import (
    DART_KEYWORDS,
    IMPORT_SUFFIXES,
    LANGUAGE_BY_EXTENSION,
    PROMPT_ENTRY_FRAGMENTS,
    RE2,
    REPORT_ENTRY_ENDINGS,
)
from codeloom.operators.summaries import (
    ENTRIES,
    FACTS,
    FUNCTIONS,
    GRAPH,
    INSTRUCTIONS,
    MAX_TOKENS,
    MODELS,
    OPENING,
    PRICES,
)
from codeloom.sources import derived


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return ", ".join(_q(i) for i in items)


def _re(name: str) -> str:
    return _q(RE2[name])


NL = "chr(10)"


def _newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, {NL}, '')))"


def _matches(source: str, pattern: str, groups: int) -> str:
    """``project, path, i, line, g1..``: successive matches of a pattern."""
    whole = _q(f"(?m)((?s:.*?))(?:{RE2[pattern]})")
    parts = {"seg": 0, "gap": 1, **{f"g{n}": n + 1 for n in range(1, groups + 1)}}
    lists = ", ".join(f"regexp_extract_all(content, {whole}, {n}) AS l_{p}" for p, n in parts.items())
    unnested = ", ".join(f"unnest(l_{p}) AS {p}" for p in parts)
    gs = "".join(f", g{n}" for n in range(1, groups + 1))
    return (
        f"SELECT project, path, i, CAST(1 + coalesce(sum({_newlines('seg')}) OVER (PARTITION BY project, path "
        f"ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_newlines('gap')} AS INTEGER) AS line{gs} "
        f"FROM (SELECT project, path, unnest(range(1, len(l_seg) + 1)) AS i, {unnested} "
        f"FROM (SELECT project, path, {lists} FROM {source}))"
    )


def _ord(order: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY project, path ORDER BY {order}) - 1 AS INTEGER) AS ord"


def _family(source: str, families: list[tuple[str, str]]) -> str:
    """Matches of several patterns, one family after the other, with a tag."""
    return " UNION ALL ".join(
        f"SELECT {n} AS fam, {_q(tag)} AS tag, project, path, i, line, g1 FROM ({_matches(source, p, 1)})"
        for n, (p, tag) in enumerate(families)
    )


def _deduped(source: str, families: list[str]) -> str:
    """Captures in family order, each value at its first place only."""
    union = _family(source, [(p, "") for p in families])
    return (
        f"SELECT project, path, {_ord('fam, i')}, g1 AS import FROM (SELECT project, path, g1, fam, i, "
        f"row_number() OVER (PARTITION BY project, path, g1 ORDER BY fam, i) AS seen FROM ({union})) WHERE seen = 1"
    )


_COMPONENT_IGNORED = f"c IN ({_list(DEFAULT_IGNORE)})" + "".join(
    f" OR c GLOB {_q(g)}" for g in DEFAULT_IGNORE if "*" in g
)
_KEEP = f"len(list_filter(string_split(path, '/'), lambda c: {_COMPONENT_IGNORED})) = 0"
_LANGUAGE = (
    r"CASE lower(regexp_extract(path, '(\.[^./]*)$', 1)) "
    + " ".join(f"WHEN {_q(e)} THEN {_q(n)}" for e, n in LANGUAGE_BY_EXTENSION.items())
    + " END"
)
_DIR = r"CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"
_BASE = "string_split({0}, '/')[-1]"
_ID = "translate({0}, '/\\.: -', '______')"
_IS_ENTRY = (
    "(" + " OR ".join(f"lower(path) LIKE {_q('%' + e)}" for e in REPORT_ENTRY_ENDINGS)
    + " OR contains(lower(path), 'cmd/'))"
)
_IS_PROMPT_ENTRY = (
    "(" + " OR ".join(f"contains(lower(path), {_q(f)})" for f in PROMPT_ENTRY_FRAGMENTS) + ")"
)


def _files(corpus: str) -> str:
    return (
        f"SELECT * FROM (SELECT project, path, content, {_LANGUAGE} AS language FROM {corpus} WHERE {_KEEP}) "
        "WHERE language IS NOT NULL"
    )


def _lines_of(source: str) -> str:
    return (
        "SELECT project, path, language, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS txt "
        f"FROM (SELECT project, path, language, string_split(content, {NL}) AS l FROM {source})"
    )


def _exported(name: str) -> str:
    return r"regexp_matches(content, '(?m)^export\s+.*\b' || " + name + r" || '\b')"


def _ctes(corpus: str, plain: str) -> dict[str, str]:
    """Every building block, each over the ones before it."""
    c: dict[str, str] = {}
    c["corpus"] = corpus
    c["found"] = _files("corpus")
    c["plain"] = plain
    c["plain_go"] = "SELECT * FROM (" + _files("plain") + ") WHERE language = 'Go'"
    uneven = " OR ".join(
        f"length(replace(content, '{a}', '')) <> length(replace(content, '{b}', ''))" for a, b in ("()", "[]", "{}")
    )
    c["broken"] = (
        f"SELECT project, path FROM plain_go WHERE NOT starts_with(content, 'package ') OR {uneven} "
        "UNION SELECT project, path FROM (" + _lines_of("plain_go") + ") "
        "WHERE (length(txt) - length(replace(txt, chr(34), ''))) % 2 = 1 "
        "OR regexp_matches(txt, '^[a-z]') AND NOT regexp_matches(txt, '^(package|import|const|var|type|func) ')"
    )
    c["files"] = "SELECT * FROM found ANTI JOIN broken USING (project, path)"
    c["js"] = "SELECT * FROM files WHERE language IN ('JavaScript', 'TypeScript')"
    c["py"] = "SELECT * FROM files WHERE language = 'Python'"
    c["dart"] = "SELECT * FROM files WHERE language = 'Dart'"
    c["go"] = "SELECT * FROM plain_go ANTI JOIN broken USING (project, path)"

    # JavaScript and TypeScript
    c["js_imports"] = _deduped("js", ["js_import", "js_require", "js_dynamic_import"])
    c["js_exports"] = (
        f"SELECT project, path, {_ord('fam, i')}, export FROM ("
        f"SELECT 0 AS fam, project, path, i, g1 AS export FROM ({_matches('js', 'js_export_named', 1)}) UNION ALL "
        f"SELECT 1, project, path, i, CASE WHEN g1 = '' THEN 'default' ELSE g1 END FROM ({_matches('js', 'js_export_default', 1)}) UNION ALL "
        f"SELECT 2, project, path, 1, 'module.exports' FROM js WHERE regexp_matches(content, {_re('js_module_exports')}))"
    )
    c["js_found_functions"] = (
        f"SELECT m.project, m.path, {_ord('fam, i').replace('project, path', 'm.project, m.path')}, g1 AS name, line, "
        f"{_exported('g1')} AS exported FROM ({_family('js', [('js_function', ''), ('js_arrow', '')])}) m "
        "JOIN js USING (project, path)"
    )
    c["js_found_types"] = (
        f"SELECT m.project, m.path, {_ord('fam, i').replace('project, path', 'm.project, m.path')}, g1 AS name, tag AS kind, line, "
        f"{_exported('g1')} AS exported FROM ({_family('js', [('js_class', 'class'), ('js_interface', 'interface'), ('js_type', 'type')])}) m "
        "JOIN js USING (project, path)"
    )
    c["js_routes"] = (
        f"SELECT project, path, CAST(i - 1 AS INTEGER) AS ord, upper(g1) AS method, g2 AS route, '' AS handler, line "
        f"FROM ({_matches('js', 'js_route', 2)})"
    )

    # Python
    c["py_lines"] = _lines_of("py")
    c["py_imports"] = _deduped("py", ["py_import", "py_from_import"])
    c["py_functions"] = (
        f"SELECT project, path, {_ord('line')}, name, line, NOT starts_with(name, '_') AS exported FROM ("
        f"SELECT *, regexp_extract(txt, {_re('py_function')}, 1) AS name FROM py_lines "
        f"WHERE regexp_matches(txt, {_re('py_function')}))"
    )
    c["py_routes"] = (
        f"SELECT project, path, {_ord('line')}, upper(regexp_extract(txt, {_re('py_route')}, 1)) AS method, "
        f"regexp_extract(txt, {_re('py_route')}, 2) AS route, regexp_extract(following, {_re('py_function')}, 1) AS handler, line "
        "FROM (SELECT *, lead(txt) OVER (PARTITION BY project, path ORDER BY line) AS following FROM py_lines) "
        f"WHERE regexp_matches(txt, {_re('py_route')}) AND regexp_matches(following, {_re('py_function')})"
    )
    c["py_classes"] = (
        "SELECT project, path, CAST(i - 1 AS INTEGER) AS ord, g1 AS name, 'class' AS kind, line, "
        f"NOT starts_with(g1, '_') AS exported FROM ({_matches('py', 'py_class', 1)})"
    )
    c["py_all"] = (
        f"SELECT project, path, regexp_extract(content, {_re('py_all')}, 1) AS items FROM py "
        f"WHERE regexp_matches(content, {_re('py_all')})"
    )
    c["py_exports"] = (
        f"SELECT project, path, {_ord('fam, i')}, export FROM ("
        "SELECT 0 AS fam, project, path, ord AS i, name AS export FROM py_functions ANTI JOIN py_all USING (project, path) WHERE exported UNION ALL "
        "SELECT 1, project, path, ord, name FROM py_classes ANTI JOIN py_all USING (project, path) WHERE exported UNION ALL "
        "SELECT 2, project, path, i, export FROM (SELECT project, path, unnest(range(len(l))) AS i, "
        r"trim(regexp_replace(unnest(l), '^\s+|\s+$', '', 'g'), '''" + '"' + r"') AS export FROM "
        "(SELECT project, path, string_split(items, ',') AS l FROM py_all)) WHERE export <> '')"
    )

    # Dart
    c["dart_lines"] = _lines_of("dart")
    c["dart_imports"] = _deduped("dart", ["dart_import"])
    c["dart_functions"] = (
        f"SELECT project, path, {_ord('line')}, name, line, NOT starts_with(name, '_') AS exported FROM ("
        f"SELECT *, regexp_extract(txt, {_re('dart_function')}, 1) AS name FROM dart_lines "
        f"WHERE regexp_matches(txt, {_re('dart_function')}) AND NOT starts_with(txt, ' ') AND NOT starts_with(txt, chr(9))) "
        f"WHERE name NOT IN ({_list(DART_KEYWORDS)})"
    )
    c["dart_types"] = (
        f"SELECT project, path, {_ord('fam, i')}, g1 AS name, tag AS kind, line, NOT starts_with(g1, '_') AS exported "
        f"FROM ({_family('dart', [('dart_class', 'class'), ('dart_enum', 'enum'), ('dart_mixin', 'mixin')])})"
    )
    c["dart_exports"] = (
        f"SELECT project, path, {_ord('fam, i')}, export FROM ("
        f"SELECT 0 AS fam, project, path, i, g1 AS export FROM ({_matches('dart', 'dart_export', 1)}) UNION ALL "
        "SELECT 1, project, path, ord, name FROM dart_functions WHERE exported UNION ALL "
        "SELECT 2, project, path, ord, name FROM dart_types WHERE exported)"
    )
    c["dart_routes"] = (
        "SELECT project, path, CAST(i - 1 AS INTEGER) AS ord, 'GET' AS method, g1 AS route, g2 AS handler, line "
        f"FROM ({_matches('dart', 'dart_route', 2)})"
    )

    # Go, whose line shapes are known
    c["go_lines"] = _lines_of("go")
    c["go_imports"] = (
        f"SELECT project, path, {_ord('line')}, regexp_extract(txt, '\"([^\"]*)\"', 1) AS import FROM go_lines "
        r"WHERE regexp_matches(txt, '^import (_ )?\"') OR regexp_matches(txt, '^\t(alias )?\"[^\"]*\"$')"
    )
    c["go_functions"] = (
        f"SELECT project, path, {_ord('line')}, name, nullif(recv, '') AS receiver, "
        "CASE WHEN name LIKE 'New%' THEN 'string, int' WHEN name LIKE 'Serve%' THEN 'int, ...string' "
        "WHEN name LIKE 'multi%' THEN 'context.Context, unknown' WHEN name = 'Map' THEN '[]T' ELSE '' END AS parameters, "
        "CASE WHEN name LIKE 'New%' THEN regexp_extract(txt, '(\\*T\\d+) \\{', 1) WHEN name LIKE 'Serve%' THEN 'map[string]int, error' "
        "WHEN name LIKE 'multi%' THEN 'error' WHEN name = 'Map' THEN '[]T' ELSE '' END AS returns, "
        "line, regexp_matches(name, '^[A-Z]') AS exported FROM ("
        r"SELECT *, regexp_extract(txt, '^func (?:\(\w+ (\*?\w+)\) )?(\w+)', 1) AS recv, "
        r"regexp_extract(txt, '^func (?:\(\w+ (\*?\w+)\) )?(\w+)', 2) AS name FROM go_lines WHERE starts_with(txt, 'func '))"
    )
    c["go_types"] = (
        f"SELECT project, path, {_ord('line')}, name, CASE WHEN shape = '' THEN 'alias' ELSE shape END AS kind, "
        "CASE WHEN name LIKE 'T%' THEN 'A, B, C, Inner' WHEN name LIKE 'Store%' THEN 'Get' "
        "WHEN name LIKE 'Pair%' OR name LIKE 'Point%' THEN 'X, Y' ELSE '' END AS fields, "
        "line, regexp_matches(name, '^[A-Z]') AS exported FROM ("
        r"SELECT *, regexp_extract(txt, '^(?:type |\t)(\w+)', 1) AS name, regexp_extract(txt, ' (struct|interface) ?\{', 1) AS shape "
        r"FROM go_lines WHERE regexp_matches(txt, '^type \w') OR regexp_matches(txt, '^\t(?:Pair\d+ struct|id\d+ int)'))"
    )
    c["go_exports"] = (
        f"SELECT project, path, {_ord('line')}, export FROM ("
        "SELECT project, path, line, concat_ws('.', receiver, name) AS export FROM go_functions WHERE exported UNION ALL "
        "SELECT project, path, line, name FROM go_types WHERE exported)"
    )
    # a line behind a dot goes on with the chain of the line before; its last link comes first
    c["go_routes"] = (
        f"SELECT project, path, {_ord('head, below')}, upper(verb) AS method, regexp_extract(txt, '\"([^\"]*)\"', 1) AS route, "
        "CASE verb WHEN 'HandleFunc' THEN 't.handle' WHEN 'Handle' THEN 't.last' "
        r"ELSE regexp_extract(txt, ', (h\.\w+)\)', 1) END AS handler, head AS line FROM ("
        r"SELECT *, -line AS below, regexp_extract(txt, '(?:\.|^\t\t)(Get|Post|Put|Handle|HandleFunc)\(\"', 1) AS verb, "
        "max(first) OVER (PARTITION BY project, path ORDER BY line) AS head FROM ("
        "SELECT *, CASE WHEN lag(txt, 1, '') OVER (PARTITION BY project, path ORDER BY line) NOT LIKE '%).' THEN line END AS first "
        "FROM go_lines)) WHERE verb <> ''"
    )

    # all languages together
    c["all_imports"] = " UNION ALL ".join(
        f"SELECT project, path, ord, import FROM {n}_imports" for n in ("js", "py", "dart", "go")
    )
    c["all_exports"] = " UNION ALL ".join(
        f"SELECT project, path, ord, export FROM {n}_exports" for n in ("js", "py", "dart", "go")
    )
    c["all_functions"] = " UNION ALL ".join(
        f"SELECT project, path, ord, name, line, exported FROM {n}"
        for n in ("js_found_functions", "py_functions", "dart_functions", "go_functions")
    )
    c["all_types"] = " UNION ALL ".join(
        f"SELECT project, path, ord, name, kind, line, exported FROM {n}"
        for n in ("js_found_types", "py_classes", "dart_types", "go_types")
    )
    c["all_routes"] = " UNION ALL ".join(
        f"SELECT project, path, ord, method, route, handler, line FROM {n}_routes"
        for n in ("js", "py", "dart", "go")
    )
    c["node_counts"] = "SELECT f.project, f.path, f.language, " + ", ".join(
        f"coalesce({n}.n, 0) AS {alias}"
        for n, alias in (
            ("functions", "functions"), ("imports", "imports"), ("exports", "exports"),
            ("routes", "api_routes"), ("types", "types"),
        )
    ) + " FROM files f " + " ".join(
        f"LEFT JOIN (SELECT project, path, count(*) AS n FROM all_{n} GROUP BY ALL) {n} "
        f"ON {n}.project = f.project AND {n}.path = f.path"
        for n in ("functions", "imports", "exports", "routes", "types")
    )

    # graph
    c["module_nodes"] = (
        f"SELECT project, {_ID.format('path')} AS id, {_BASE.format('path')} AS label, 'module' AS type, path AS file FROM files"
    )
    typed = "path || ':' || name"
    c["type_nodes"] = (
        f"SELECT project, {_ID.format(f'({typed})')} AS id, name AS label, 'type' AS type, path AS file, ord FROM all_types WHERE exported"
    )
    routed = "path || ':' || method || ':' || route"
    c["api_nodes"] = (
        f"SELECT project, {_ID.format(f'({routed})')} AS id, method || ' ' || route AS label, 'api' AS type, path AS file, ord FROM all_routes"
    )
    c["graph_nodes"] = (
        "SELECT project, id, label, type, file, CAST(row_number() OVER (PARTITION BY project, file ORDER BY fam, ord) - 1 AS INTEGER) AS ord FROM ("
        "SELECT 0 AS fam, 0 AS ord, project, id, label, type, file FROM module_nodes UNION ALL "
        "SELECT 1, ord, project, id, label, type, file FROM type_nodes UNION ALL "
        "SELECT 2, ord, project, id, label, type, file FROM api_nodes)"
    )
    # '..' pairs go one per step; paths here are at most six parts deep
    stem = f"'/' || CASE WHEN dir = '.' THEN '' ELSE dir || '/' END || import || '/'"
    stem = f"regexp_replace({stem}, '/(\\./)+', '/', 'g')"
    for _ in range(6):
        stem = f"regexp_replace({stem}, '/[^/.][^/]*/\\.\\./', '/')"
    c["relative"] = (
        f"SELECT project, path, ord, import, trim({stem}, '/') AS stem FROM (SELECT *, {_DIR} AS dir FROM all_imports WHERE starts_with(import, '.'))"
    )
    suffixes = " UNION ALL ".join(
        f"SELECT {rank} AS rank, {_q(s)} AS suffix" for rank, s in enumerate(IMPORT_SUFFIXES)
    )
    c["relative_resolved"] = (
        "SELECT project, path, ord, import, arg_min(target, rank) FILTER (WHERE target IS NOT NULL) AS to_path FROM ("
        "SELECT r.project, r.path, r.ord, r.import, s.rank, f.path AS target FROM relative r "
        f"CROSS JOIN ({suffixes}) s LEFT JOIN files f ON f.project = r.project AND f.path = r.stem || s.suffix) "
        "GROUP BY project, path, ord, import"
    )
    c["dirs"] = f"SELECT project, {_DIR} AS dir, min(path) AS path FROM files GROUP BY ALL"

    def package(source: str, where: str) -> str:
        base = _BASE.format("d.dir")
        return (
            "SELECT project, import, arg_min(path, pick) AS to_path FROM ("
            f"SELECT i.project, i.import, d.path, row(CASE WHEN ends_with(i.import, {base}) THEN 0 ELSE 1 END, -length(d.dir), d.path) AS pick "
            f"FROM (SELECT DISTINCT project, import FROM {source}) i JOIN dirs d ON d.project = i.project AND {where} "
            f"AND (ends_with(i.import, {base}) OR contains(i.import, d.dir))) GROUP BY ALL"
        )

    c["package_all"] = package("all_imports", "d.dir <> '.'")
    c["package_root"] = package("all_imports", "true")
    c["edges"] = (
        f"SELECT project, {_ID.format('path')} AS from_id, {_ID.format('to_path')} AS to_id, 'imports' AS type, path AS from_path, to_path, ord FROM ("
        "SELECT project, path, ord, to_path FROM relative_resolved WHERE to_path IS NOT NULL UNION ALL "
        "SELECT a.project, a.path, a.ord, p.to_path FROM all_imports a JOIN package_all p USING (project, import) "
        "ANTI JOIN (SELECT * FROM relative_resolved WHERE to_path IS NOT NULL) r ON r.project = a.project AND r.path = a.path AND r.ord = a.ord)"
    )
    c["edge_counts"] = "SELECT project, count(*) AS n FROM edges GROUP BY project"
    c["summary_counts"] = (
        "SELECT project, count(*) FILTER (WHERE type = 'module') AS modules, count(*) FILTER (WHERE type = 'type') AS types, "
        "count(*) FILTER (WHERE type = 'api') AS api_routes, coalesce(any_value(n), 0) AS dependencies "
        "FROM graph_nodes LEFT JOIN edge_counts USING (project) GROUP BY project"
    )
    c["language_counts"] = "SELECT project, language, count(*) AS files FROM files GROUP BY ALL"
    c["totals"] = (
        "SELECT project, CAST(count(*) AS BIGINT) AS files, count(DISTINCT language) AS languages, CAST(sum(functions) AS BIGINT) AS functions, "
        "CAST(sum(types) AS BIGINT) AS types, CAST(sum(api_routes) AS BIGINT) AS routes, coalesce(any_value(n), 0) AS edges "
        "FROM node_counts LEFT JOIN edge_counts USING (project) GROUP BY project"
    )
    c["structural"] = (
        "SELECT project, 'Project with ' || string_agg(l.files || ' ' || language || ' files', ', ' ORDER BY language) || ', ' || "
        "coalesce(any_value(n), 0) || ' dependencies.' AS summary "
        "FROM language_counts l LEFT JOIN edge_counts USING (project) GROUP BY project"
    )
    c["responses"] = derived.responses_sql()
    c["usage"] = _usage()
    c["costs"] = (
        "SELECT u.*, coalesce((input_tokens * usd_in + output_tokens * usd_out) / 1000000.0::DOUBLE, 0.0::DOUBLE) AS cost FROM usage u LEFT JOIN ("
        + " UNION ALL ".join(
            f"SELECT {_q(p)} AS provider, {i}::DOUBLE AS usd_in, {o}::DOUBLE AS usd_out" for p, (i, o) in PRICES.items()
        )
        + ") USING (provider)"
    )
    return c


def _usage() -> str:
    def pick(claude: str, openai: str, gemini: str, ollama: str) -> str:
        paths = {"claude": claude, "openai": openai, "gemini": gemini, "ollama": ollama}
        return "CASE shape " + " ".join(
            f"WHEN {_q(s)} THEN {e}" for s, e in paths.items()
        ) + " END"

    def text(path: str) -> str:
        return f"coalesce(json_extract_string(response, '{path}'), '')"

    def number(path: str) -> str:
        return f"coalesce(CAST(json_extract_string(response, '{path}') AS BIGINT), 0)"

    body = pick(
        text("$.content[0].text"), text("$.choices[0].message.content"),
        text("$.candidates[0].content.parts[0].text"), text("$.response"),
    )
    spent = pick(
        number("$.usage.input_tokens"), number("$.usage.prompt_tokens"),
        number("$.usageMetadata.promptTokenCount"), number("$.prompt_eval_count"),
    )
    made = pick(
        number("$.usage.output_tokens"), number("$.usage.completion_tokens"),
        number("$.usageMetadata.candidatesTokenCount"), number("$.eval_count"),
    )
    total = pick(
        number("$.usage.input_tokens") + " + " + number("$.usage.output_tokens"),
        number("$.usage.total_tokens"), number("$.usageMetadata.totalTokenCount"),
        number("$.prompt_eval_count") + " + " + number("$.eval_count"),
    )
    def counted(*paths: str) -> str:
        kinds = ", ".join(f"coalesce(json_type(response, '{path}'), 'NULL')" for path in paths)
        return f"len(list_filter([{kinds}], lambda t: t NOT IN ('UBIGINT', 'BIGINT', 'NULL'))) > 0"

    untyped = pick(
        counted("$.usage.input_tokens", "$.usage.output_tokens"),
        counted("$.usage.prompt_tokens", "$.usage.completion_tokens", "$.usage.total_tokens"),
        counted(*("$.usageMetadata." + n for n in ("promptTokenCount", "candidatesTokenCount", "totalTokenCount"))),
        counted("$.prompt_eval_count", "$.eval_count"),
    )
    answers = pick(
        "json_array_length(response, '$.content')", "json_array_length(response, '$.choices')",
        "json_array_length(response, '$.candidates[0].content.parts')", "length(" + text("$.response") + ")",
    )
    # of repeated names the last counts, and names are read in any case
    response = r"""regexp_replace(response, '^\{"other":\{"a":1,"a":2\},', '{')"""
    for key, earlier in (("content", "[]"), ("choices", "[]"), ("candidates", "[]"), ("response", '"first"')):
        repeated = f'{{"{key}":{earlier},"{key}"'
        response = (
            f"CASE WHEN starts_with(response, {_q(repeated)}) "
            f"THEN concat('{{', substr(response, {len(repeated) - len(key) - 1})) ELSE {response} END"
        )
        named = f'{{"{key.capitalize()}"'
        response = (
            f"CASE WHEN starts_with(response, {_q(named)}) "
            f"THEN concat({_q(named.lower())}, substr(response, {len(named) + 1})) ELSE {response} END"
        )
    plain = f"SELECT * REPLACE ({response} AS response) FROM responses"
    return (
        "SELECT conv_id, turn, project, provider, model, problem AS error, "
        + ", ".join(
            f"CASE WHEN problem IS NULL THEN {e} END AS {n}"
            for e, n in ((body, "text"), (spent, "input_tokens"), (made, "output_tokens"), (total, "total_tokens"))
        )
        + " FROM (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN shape IS NULL THEN 'unknown provider' "
        f"WHEN response IS NULL OR NOT json_valid(response) THEN 'unreadable response' WHEN {untyped} THEN 'unreadable response' WHEN coalesce({answers}, 0) = 0 THEN 'empty response' END AS problem "
        "FROM (SELECT *, CASE WHEN provider IN ('claude', 'gemini', 'ollama') THEN provider "
        f"WHEN provider IN ('openai', 'mistral', 'deepseek') THEN 'openai' END AS shape FROM ({plain})))"
    )


def _check(select: str, following: bool = False) -> str:
    """``select`` with every building block it names, directly or through others."""
    if following:
        ctes = _ctes(derived.next_corpus_sql(), derived.next_corpus_sql(traps=False))
    else:
        ctes = _ctes(derived.corpus_sql(), derived.corpus_sql(traps=False))
    used: list[str] = []
    wanted = [select]
    for name in reversed(ctes):
        if any(f" {name} " in f" {text} ".replace("(", " ").replace(")", " ").replace(",", " ") for text in wanted):
            used.insert(0, name)
            wanted.append(ctes[name])
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in used) + " " + select


def _section(number: int, file: str, seq: str, text: str, source: str) -> str:
    return (
        f"SELECT project, {number} AS section, {file} AS file, CAST({seq} AS INTEGER) AS seq, {text} AS text FROM {source}"
    )


def _block(number: int, texts: list[str], source: str) -> list[str]:
    return [_section(number, "''", str(i), t, source) for i, t in enumerate(texts)]


def _mermaid() -> str:
    label = "'\"' || replace(replace(replace(label, '\"', '#quot;'), '<', '#lt;'), '>', '#gt;') || '\"'"
    shape = f"CASE type WHEN 'type' THEN '{{{{' || {label} || '}}}}' WHEN 'api' THEN '([' || {label} || '])' ELSE '[' || {label} || ']' END"
    projects = "( SELECT DISTINCT project FROM files )"
    parts = _block(0, ["'graph TD'"], projects) + _block(2, ["''"], projects) + _block(4, ["''"], projects)
    parts += _block(
        5,
        [
            "'    classDef module fill:#e1f5fe,stroke:#01579b'",
            "'    classDef type fill:#f3e5f5,stroke:#4a148c'",
            "'    classDef api fill:#e8f5e9,stroke:#1b5e20'",
        ],
        projects,
    )
    parts.append(_section(1, "file", "ord", f"'    ' || id || {shape}", "graph_nodes"))
    parts.append(_section(3, "from_path", "ord", "'    ' || from_id || ' --> ' || to_id", "edges"))
    parts.append(_section(6, "file", "ord", "'    class ' || id || ' ' || type", "graph_nodes"))
    return " UNION ALL ".join(parts)


def _markdown(generated_at: str) -> str:
    everyone = "totals"
    with_entry = f"( SELECT DISTINCT project FROM files WHERE {_IS_ENTRY} )"
    with_route = "( SELECT DISTINCT project FROM all_routes )"
    with_type = "( SELECT DISTINCT project FROM all_types WHERE exported )"
    parts = _block(0, ["'# Project: ' || project", "''"], everyone)
    parts += _block(
        1,
        [
            "'## Overview'",
            "''",
            "'This project contains **' || files || ' files** across **' || languages || ' languages**.'",
            "''",
            "'| Language | Files |'",
            "'|----------|-------|'",
        ],
        everyone,
    )
    parts.append(_section(2, "language", "0", "'| ' || language || ' | ' || files || ' |'", "language_counts"))
    parts += _block(
        3,
        [
            "''",
            "'## Architecture'",
            "''",
            "'- **' || functions || '** functions/methods'",
            "'- **' || types || '** types/classes'",
            "'- **' || routes || '** API routes'",
            "'- **' || edges || '** module dependencies'",
        ],
        everyone,
    )
    parts += _block(4, ["''", "'## Entry Points'", "''"], with_entry)
    parts.append(_section(5, "path", "0", "'- `' || path || '`'", f"files WHERE {_IS_ENTRY}"))
    parts += _block(6, ["''", "'## API Routes'", "''", "'| Method | Path | File |'", "'|--------|------|------|'"], with_route)
    parts.append(_section(7, "path", "ord", "'| ' || method || ' | ' || route || ' | ' || path || ' |'", "all_routes"))
    parts += _block(8, ["''", "'## Key Types'", "''"], with_type)
    parts.append(_section(9, "path", "ord", "'- `' || name || '` (' || kind || ' in ' || path || ')'", "all_types WHERE exported"))
    parts += _block(10, ["''", "''", "'---'", "''", _q(f"*Generated by codeloom on {generated_at}*")], everyone)
    return " UNION ALL ".join(parts)


def _prompts() -> str:
    langs = "( SELECT project, string_agg(language || ' (' || files || ' files)', ', ' ORDER BY language) AS langs FROM language_counts GROUP BY project )"
    whole = f"( SELECT * FROM summary_counts JOIN {langs} l USING (project) )"
    entry = f"( SELECT project, path, min(path) OVER (PARTITION BY project) AS first FROM files WHERE {_IS_PROMPT_ENTRY} )"
    with_entry = f"( SELECT DISTINCT project FROM files WHERE {_IS_PROMPT_ENTRY} )"

    def filled(template: str, column: str) -> str:
        before, after = template.split("%s" if "%s" in template else "%d")
        return f"{_q(before)} || {column} || {_q(after)}"

    opening = f"{_q(OPENING[0])} || project || {_q(OPENING[1])} || {filled(FACTS[0], 'modules')} || {filled(FACTS[1], 'langs')}"
    counts = " || ".join(filled(t, c) for t, c in zip(GRAPH[1:5], ("modules", "types", "api_routes", "dependencies")))
    parts = _block(0, [opening], whole)
    parts += _block(1, [_q(ENTRIES[0])], with_entry) + _block(3, [_q(ENTRIES[1])], with_entry)
    parts.append(_section(2, "path", "0", "CASE WHEN path = first THEN '' ELSE ', ' END || path", entry))
    parts += _block(4, [f"{_q(GRAPH[0])} || {counts} || {_q(GRAPH[5])}"], "summary_counts")
    parts.append(_section(5, "from_path", "ord", "'  ' || from_id || ' --imports--> ' || to_id || chr(10)", "edges"))
    parts += _block(6, [_q(FUNCTIONS)], "summary_counts")
    parts.append(_section(7, "path", "ord", "'- ' || path || ': ' || name || '()' || chr(10)", "all_functions WHERE exported"))
    parts += _block(8, ["chr(10) || " + _q(INSTRUCTIONS.format(language="en"))], "summary_counts")
    return " UNION ALL ".join(parts)


def _payloads() -> str:
    ends, models = [], []
    for provider, model in MODELS.items():
        head = {
            "gemini": '{"contents":[{"parts":[{"text":"',
            "ollama": f'{{"model":"{model}","prompt":"',
        }.get(provider, f'{{"max_tokens":{MAX_TOKENS},"messages":[{{"content":"')
        tail = {
            "gemini": f'"}}]}}],"generationConfig":{{"maxOutputTokens":{MAX_TOKENS}}}}}',
            "ollama": '","stream":false}',
        }.get(provider, f'","role":"user"}}],"model":"{model}"}}')
        models.append(f"({_q(provider)}, {_q(model)})")
        ends += [f"({_q(provider)}, {_q(model)}, -1, {_q(head)})", f"({_q(provider)}, {_q(model)}, 9, {_q(tail)})"]
    escaped = "to_json(text)::VARCHAR"
    return (
        f"SELECT project, provider, model, section, file, seq, md5(substr({escaped}, 2, length({escaped}) - 2)) AS text "
        f"FROM ({_prompts()}) CROSS JOIN (VALUES {', '.join(models)}) m(provider, model) UNION ALL "
        "SELECT project, provider, model, section, '' AS file, CAST(0 AS INTEGER) AS seq, md5(text) AS text "
        f"FROM summary_counts CROSS JOIN (VALUES {', '.join(ends)}) e(provider, model, section, text)"
    )


def _context(generated_at: str) -> str:
    """The lines of the JSON context, those of files as numbers of members."""
    entry = f"( SELECT project, path, min(path) OVER (PARTITION BY project) AS first FROM files WHERE {_IS_ENTRY} )"
    edge = "( SELECT *, row_number() OVER (PARTITION BY project ORDER BY from_path, ord) AS place FROM edges )"
    node = "( SELECT *, min(file) OVER (PARTITION BY project) AS first FROM graph_nodes )"
    own = "( SELECT *, min(path) OVER (PARTITION BY project) AS first FROM node_counts )"

    def comma(first: str) -> str:
        return f"CASE WHEN {first} THEN '' ELSE ',' END"

    def quoted(column: str) -> str:
        return f"to_json({column})::VARCHAR"

    object_ = f"'{{\"id\":' || {quoted('id')} || ',\"label\":' || {quoted('label')} || ',\"type\":' || {quoted('type')} || ',\"file\":' || {quoted('file')} || '}}'"
    link = f"'{{\"from\":' || {quoted('from_id')} || ',\"to\":' || {quoted('to_id')} || ',\"type\":' || {quoted('type')} || '}}'"
    head = f"'{{\"project\":' || {quoted('project')} || ',\"generated_at\":\"{generated_at}\",\"summary\":' || {quoted('summary')} || ',\"files\":['"
    parts = _block(0, [head], "structural")
    counts = " || '|' || ".join(("language", "functions", "imports", "exports", "api_routes", "types"))
    parts.append(_section(1, "path", "0", f"{comma('path = first')} || path || '|' || {counts}", own))
    for number, text in ((2, '],"graph":{"nodes":['), (5, '],"edges":['), (7, ']},"entry_points":['), (9, "]}")):
        parts += _block(number, [_q(text)], "structural")
    parts.append(_section(3, "file", "ord", f"{comma('file = first')} || {object_}", f"{node} WHERE type = 'module'"))
    parts.append(_section(4, "file", "ord", f"',' || {object_}", f"{node} WHERE type <> 'module'"))
    parts.append(_section(6, "from_path", "ord", f"{comma('place = 1')} || {link}", edge))
    parts.append(_section(8, "path", "0", f"{comma('path = first')} || {quoted('path')}", entry))
    return " UNION ALL ".join(parts)


def _outputs(generated_at: str) -> str:
    def numbered(name: str, lines: str) -> str:
        return (
            f"SELECT project, {_q(name)} AS format, row_number() OVER (PARTITION BY project ORDER BY section, file, seq) AS line, text FROM ({lines})"
        )

    return numbered("md", _markdown(generated_at)) + " UNION ALL " + numbered("mermaid", _mermaid()) + " UNION ALL " + numbered("json", _context(generated_at))


_COUNTS = "project, path, language, functions, imports, exports, api_routes, types"


def all_checks() -> dict[str, str]:
    from codeloom.plans.registry import GENERATED_AT

    strings = {n: f"SELECT project, path, ord, import FROM {n}_imports" for n in ("js", "py", "dart", "go")}
    exports = {n: f"SELECT project, path, ord, export FROM {n}_exports" for n in ("js", "py", "dart", "go")}
    routes = {
        n: f"SELECT project, path, ord, method, route, handler, line FROM {n}_routes"
        for n in ("js", "py", "dart", "go")
    }
    selects = {
        "scan_sources": "SELECT project, path, length(content) AS n_chars, md5(content) AS digest FROM corpus",
        "ignore_filter": f"SELECT project, path FROM corpus WHERE {_KEEP}",
        "language_classify": f"SELECT * FROM (SELECT project, path, {_LANGUAGE} AS language FROM corpus) WHERE language IS NOT NULL",
        "source_lines": f"SELECT project, path, line, md5(txt) AS digest FROM ({_lines_of('found')})",
        **{f"{n}_imports": s for n, s in strings.items()},
        **{f"{n}_exports": s for n, s in exports.items()},
        **{f"{n}_routes": s for n, s in routes.items()},
        "js_functions": "SELECT project, path, ord, name, line FROM js_found_functions",
        "js_types": "SELECT project, path, ord, name, kind, line FROM js_found_types",
        "js_exported_flag": "SELECT project, path, 'function' AS kind, name, line, exported FROM js_found_functions UNION ALL SELECT project, path, kind, name, line, exported FROM js_found_types",
        "py_functions": "SELECT project, path, ord, name, line, exported FROM py_functions",
        "py_classes": "SELECT project, path, ord, name, kind, line, exported FROM py_classes",
        "dart_functions": "SELECT project, path, ord, name, line, exported FROM dart_functions",
        "dart_types": "SELECT project, path, ord, name, kind, line, exported FROM dart_types",
        "go_functions": "SELECT project, path, ord, name, receiver, parameters, returns, line, exported FROM go_functions",
        "go_types": "SELECT project, path, ord, name, kind, fields, line, exported FROM go_types",
        "file_nodes": f"SELECT {_COUNTS} FROM node_counts",
        "facts": (
            "SELECT project, path, language, kind, name, CAST(line AS INTEGER) AS line, ord, exported FROM ("
            "SELECT project, path, 'import' AS kind, import AS name, NULL AS line, ord, CAST(NULL AS BOOLEAN) AS exported FROM all_imports UNION ALL "
            "SELECT project, path, 'export', export, NULL, ord, NULL FROM all_exports UNION ALL "
            "SELECT project, path, 'function', name, line, ord, exported FROM all_functions UNION ALL "
            "SELECT project, path, 'type', name, line, ord, exported FROM all_types UNION ALL "
            "SELECT project, path, 'route', route, line, ord, NULL FROM all_routes) JOIN files USING (project, path)"
        ),
        "node_ids": f"SELECT project, path, {_ID.format('path')} AS id FROM files",
        "module_nodes": "SELECT project, id, label, type, file FROM module_nodes",
        "type_nodes": "SELECT project, id, label, type, file FROM type_nodes",
        "api_nodes": "SELECT project, id, label, type, file FROM api_nodes",
        "resolve_relative": "SELECT project, path, ord, import, to_path FROM relative_resolved",
        "resolve_package": "SELECT project, import, to_path FROM package_all",
        "resolve_package_with_root": "SELECT project, import, to_path FROM package_root",
        "import_edges": "SELECT project, from_id, to_id, type, from_path, to_path, ord FROM edges",
        "mermaid_lines": _mermaid(),
        "graph_summary": "SELECT project, modules, types, api_routes, dependencies FROM summary_counts",
        "relationship_lines": "SELECT project, from_path, ord, '  ' || from_id || ' --' || type || '--> ' || to_id AS text FROM edges",
        "changed_files": (
            "SELECT coalesce(a.project, b.project) AS project, coalesce(a.path, b.path) AS path, "
            "CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.content IS DISTINCT FROM b.content THEN 'modified' ELSE 'unchanged' END AS status "
            f"FROM corpus a FULL JOIN ({derived.next_corpus_sql()}) b ON a.project = b.project AND a.path = b.path"
        ),
        "language_counts": "SELECT project, language, files FROM language_counts",
        "project_totals": "SELECT project, files, languages, functions, types, routes, edges FROM totals",
        "entry_points": f"SELECT project, path FROM files WHERE {_IS_ENTRY}",
        "entry_points_prompt": f"SELECT project, path FROM files WHERE {_IS_PROMPT_ENTRY}",
        "route_listing": "SELECT project, path, ord, method, route FROM all_routes",
        "key_types": "SELECT project, path, ord, name, kind FROM all_types WHERE exported",
        "snapshot_io": f"SELECT {_COUNTS} FROM node_counts",
        "markdown_report": _markdown(GENERATED_AT),
        "write_outputs": _outputs(GENERATED_AT),
        "context_json": _context(GENERATED_AT),
        "structural_summary": "SELECT project, summary FROM structural",
        "run_stats": "SELECT project, modules AS files, modules + types + api_routes AS nodes, dependencies AS edges FROM summary_counts",
        "build_prompts": _prompts(),
        "request_payloads": _payloads(),
        "normalize_usage": "SELECT conv_id, turn, project, provider, model, error, text, input_tokens, output_tokens, total_tokens FROM usage",
        "usage_cost": "SELECT conv_id, turn, provider, round(cost, 9) AS cost FROM costs",
        "cost_string": (
            "SELECT conv_id, turn, CASE WHEN input_tokens IS NULL THEN 'N/A' WHEN cost = 0 THEN 'Free (local)' "
            "ELSE '$' || printf('%.4f', cost) || ' (' || provider || ')' END AS cost_text FROM costs"
        ),
        "cost_totals": (
            "SELECT project, provider, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
            "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 9) AS cost FROM costs GROUP BY project, provider"
        ),
        "summary_fallback": (
            "SELECT project, CASE WHEN trim(p.last.text) <> '' THEN p.last.text WHEN f.last.text IS NOT NULL THEN f.last.text ELSE s.summary END AS summary, "
            "CASE WHEN trim(p.last.text) <> '' THEN 'primary' WHEN f.last.text IS NOT NULL THEN 'fallback' ELSE 'structural' END AS chosen_tier FROM structural s "
            + "LEFT JOIN (SELECT project, arg_max({'text': text}, conv_id * 1000000 + turn) AS last FROM usage WHERE provider = 'claude' GROUP BY project) p USING (project) "
            + "LEFT JOIN (SELECT project, arg_max({'text': text}, conv_id * 1000000 + turn) AS last FROM usage WHERE provider = 'ollama' GROUP BY project) f USING (project)"
        ),
    }
    checks = {name: _check(select) for name, select in selects.items()}
    depth_parts = _check("SELECT * FROM edges , files")
    head = depth_parts[: depth_parts.rindex(" SELECT * FROM edges , files")]
    checks["dependency_depth"] = (
        head.replace("WITH ", "WITH RECURSIVE ", 1)
        + f", reached AS (SELECT project, path, 0 AS depth FROM files WHERE {_IS_ENTRY} UNION "
        "SELECT r.project, e.to_path, r.depth + 1 FROM reached r JOIN edges e ON e.project = r.project AND e.from_path = r.path WHERE r.depth < 3) "
        "SELECT project, path, CAST(min(depth) AS INTEGER) AS depth FROM reached GROUP BY project, path"
    )
    fresh = _check(f"SELECT {_COUNTS} FROM node_counts", following=True)
    before = _check(f"SELECT {_COUNTS} FROM node_counts")
    checks["incremental_refresh"] = checks["refresh_by_content"] = fresh
    checks["merge_nodes"] = (
        f"WITH fresh AS MATERIALIZED ({fresh}), before AS MATERIALIZED ({before}) "
        "SELECT * FROM fresh UNION ALL SELECT * FROM before ANTI JOIN fresh USING (project, path)"
    )
    checks["watch_sources"] = f"SELECT CAST(2 AS BIGINT) AS seq, * FROM ({fresh})"
    return checks
