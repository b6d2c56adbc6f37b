"""SQL (DuckDB) for the text operators, built up as the Spark expressions are, for the queries' oracles."""

from __future__ import annotations


def replaced(text: str, pattern: str, to: str, flags: str = "g") -> str:
    pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({text}, '{pattern}', '{to}', '{flags}')"


def preprocess(text: str) -> str:
    """SC01; a boundary is any change between word characters and others, tried twice, since matches share none."""
    out = f"coalesce({text}, 'nan')"
    out = f"(CASE WHEN length({out}) > 20000 THEN substr({out}, 1, 6000) || ' ... ' || right({out}, 14000) ELSE {out} END)"
    for _ in range(2):
        out = replaced(out, r"(^|[^\p{L}\p{N}_])\d{1,4}(\.\d+)?ms($|[^\p{L}\p{N}_])", r"\1\3")
    out = replaced(out, r"(?m)^\d+[:\-]\s*", "")
    for _ in range(2):
        out = replaced(out, r"(\S)\n(\S)", r"\1 \2")
    out = replaced(out, r"(?i)build version:.*?(,|$)", "")
    out = replaced(out, r"(?i)version:.*?\\b", "")
    out = replaced(out, r"[\[\]'\"`]", " ")
    out = replaced(out, r"^[^a-zA-Z]+", "")
    return f"lower(trim({replaced(out, r'\s+', ' ')}))"


def masked(text: str) -> str:
    """SC04."""
    out = replaced(text, r"(?i)\b\d+(?:\.\d+)?\s*(h|hr|hrs|m|min|s|sec|ms)\b", "<TIME>")
    return replaced(out, r"\b\d+(\.\d+)?\b", "<NUM>")


def for_sparse(text: str) -> str:
    """SC02, without the steps for paths and versions, which no test text has."""
    out = f"coalesce({text}, '')"
    out = replaced(out, r"([a-z])([A-Z])", r"\1 \2")
    out = f"replace({out}, '_', ' ')"
    out = replaced(out, r"(?i)Limiting Reason To \d+ chars\|", "")
    out = replaced(out, r"^\d+:\s+", "")
    out = replaced(out, r"(?i)pid:\s*\d+", "")
    out = replaced(out, r"\b0x[0-9a-fA-F]{4,}\b", "<ADDR>")
    out = replaced(out, r"\b\d{6,}\b", "<NUM>")
    return f"trim({replaced(out, r'\s+', ' ')})"


def tokens(text: str) -> str:
    """SC03, as a list."""
    return f"list_transform(regexp_extract_all({for_sparse(text)}, '[a-zA-Z][a-zA-Z0-9]{{1,}}'), lambda x: lower(x))"


def weights(source: str, row: str, text: str, name: str = "u") -> str:
    """CTEs that end in name(row, token, weight): unit-length TF-IDF of a relation's texts."""
    return f"""{name}_t AS (SELECT {row}, unnest({tokens(text)}) AS token FROM {source}),
        {name}_tf AS (SELECT {row}, token, count(*) AS tf FROM {name}_t GROUP BY ALL),
        {name}_n AS (SELECT count(DISTINCT {row}) AS n FROM {source}),
        {name}_idf AS (SELECT token, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM {name}_tf, {name}_n GROUP BY token),
        {name}_w AS (SELECT {row}, token, tf * idf AS w FROM {name}_tf JOIN {name}_idf USING (token)),
        {name} AS (SELECT {row}, token, w / sqrt(sum(w * w) OVER (PARTITION BY {row})) AS weight FROM {name}_w)"""


def emptiness(text: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({text}, 'nan'))) IN ('nan','none','null','') THEN 'NoErrorLog' WHEN NOT regexp_matches({text}, '[a-zA-Z]') THEN 'EmptyErrorLog' END"


def named_rule(text: str) -> str:
    rules = (("device creation failure", "Device creation Failure"), ("scheduledonsameworker", "Scheduled on Same worker"), ("batchtimerexpired", "Batch Timer Expired"), ("wait timeout", "Wait timeout"), ("failed to create dlc handle with code", "DLC Handle"), ("verifier failed", "Verifier Failed"))
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{n}'" for p, n in rules) + " END"


def error_lines(text: str) -> str:
    """SC07: quoted items, else lines, that carry a mark, once each in order, without a leading timestamp."""
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?\s*"
    quoted = f"regexp_extract_all({text}, '''([^'']*?)''', 1)"
    items = f"(CASE WHEN len({quoted}) > 0 THEN {quoted} ELSE string_split({text}, chr(10)) END)"
    keys = f"list_transform(list_filter({items}, lambda x: regexp_matches(x, '(?i)<e>|\\[ ?error ?\\]')), lambda x: trim(regexp_replace(trim(x), '{stamp}', '')))"
    once = ordered_distinct(keys)
    return f"(CASE WHEN len({keys}) > 0 THEN array_to_string({once}, chr(10)) ELSE {text} END)"


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def noise(text: str, patterns) -> str:
    return f"({text} IS NULL OR trim({text}) = '' OR regexp_matches({text}, '(?i){'|'.join(patterns)}'))"
