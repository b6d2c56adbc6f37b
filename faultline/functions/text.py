"""Text operators on failure reasons, as Column expressions.

Patterns use Java's Unicode classes with only a line feed ending a line, explicit white-space and word classes, and
so agree with a regular-expression dialect whose classes are Unicode-aware by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, digits and word characters of Unicode, spelt out: faster than a flag that makes short classes mean them.
_SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _NOT_S, _D = f"[{_SPACES}]", f"[^{_SPACES}]", r"\p{Nd}"
_W = r"[\p{L}\p{N}_]"

# Thresholds, patterns and their order, which results depend on.
RAW_CAP, RAW_HEAD, RAW_TAIL = 20_000, 6_000, 14_000
TRIM_CAP, TRIM_HEAD, TRIM_TAIL = 5_000, 1_500, 3_500
CLEANUP_STEPS = (
    (rf"(?<!{_W}){_D}{{1,4}}(\.{_D}+)?ms(?!{_W})", ""),
    (rf"(?dm)^{_D}+[:\-]{_S}*", ""),
    (rf"\n(?<={_NOT_S}\n)(?={_NOT_S})", " "),
    (r"(?diu)build version:.*?(,|$)", ""),
    (r"(?diu)version:.*?\\b", ""),
    (r"[\[\]'\"`]", " "),
    (r"^[^a-zA-Z]+", ""),
)
# What a text must have, one of these, for a step to change it; found without a pattern, and the step skipped else.
CLEANUP_NEEDS = (("ms",), (":", "-"), ("\n",), (":",), ("\\b",), (), ())
# Two further steps would look for names with an underscore in camel case; the first two steps leave none of these.
SPARSE_STEPS = (
    (r"([a-z])([A-Z])", "$1 $2"),
    ("_", " "),
    (r"(?i)Limiting Reason To \d+ chars\|", ""),
    (r"^\d+:\s+", ""),
    (r"/prj/[^\s,;]+", "<PATH>"),
    (r"/data/local/[^\s,;]+", "<PATH>"),
    (r"/[a-zA-Z][a-zA-Z0-9_\-/]+\.[a-zA-Z]{1,5}(?=\s|,|;|$)", "<FILEPATH>"),
    (r"(?i)pid:\s*\d+", ""),
    (r"v\d+\.\d+\.\d+\.\d+[_\-][a-zA-Z0-9_\-]+", "<VERSION>"),
    (r"\bResult_\d+\b", "<RESULT>"),
    (r"\bRun\d+\b", "<RUN>"),
    (r"\b\d+\.\d+ms\b", "<TIMING>"),
    (r"(?i)within\s+[\d\.]+\s+secs?", "within <TIME> secs"),
    (r"\b0x[0-9a-fA-F]{4,}\b", "<ADDR>"),
    (r"\b\d{6,}\b", "<NUM>"),
    (r"\s+", " "),
)
NAMED_RULES = (
    ("Verifier Failed", "verifier failed"),
    ("DLC Handle", "failed to create dlc handle with code"),
    ("Wait timeout", "wait timeout"),
    ("Batch Timer Expired", "batchtimerexpired"),
    ("Scheduled on Same worker", "scheduledonsameworker"),
    ("Device creation Failure", "device creation failure"),
)
NOISE = (
    r"\btimer\s+expired\b",
    r"\bmodel\s+not\s+found\b",
    r"\bdevice\s+creation\b",
    r"\binference\s+passed\s+but\s+output\s+not\s+generated\b",
    r"\bverifier\s+failed\b",
    r"\bdevice\s+not\s+found\b",
    r"\bmissing\s+shared\s+libraries\b",
    r"\bdevice(?:[_\s-])?unavailable\b",
    r"\bnot\s+found\b",
    r"\bno\s+space\s+left\s+on\s+device\b",
    r"\bno\s+such\s+file\s+or\s+directory",
    r"\bfilenotfounderror\b",
    r"\b\w+-net-run.exe\b",
)
ERROR_PATTERNS = ("error.*", "encountered error.*", "command exited with non-zero status.*", "traceback.*", "filenotfounderror.*")
GARBAGE_TYPE, GARBAGE_PHRASES = "transformer_run", ("context size was exceeded", "segmentation fault")
TIMESTAMP_PREFIX = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\s*"


def _steps(text: Column, steps) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(to))
    return text


def preprocess(reason: Column) -> Column:
    """SC01: cap, seven clean-up steps, white space collapsed, lower case. NULL is the text 'nan'."""
    text = F.coalesce(reason, F.lit("nan"))
    text = F.when(F.length(text) > RAW_CAP, F.concat(F.substring(text, 1, RAW_HEAD), F.lit(" ... "), F.right(text, F.lit(RAW_TAIL)))).otherwise(text)
    return _cleaned(text)


def _cleaned(text: Column) -> Column:
    for (pattern, to), needs in zip(CLEANUP_STEPS, CLEANUP_NEEDS, strict=True):
        # Bound by a one-element array, so that what is before is computed once.
        text = F.transform(F.array(text), _guarded(needs, pattern, to))[0] if needs else F.regexp_replace(text, F.lit(pattern), F.lit(to))
    # Single spaces between words are as they should be; only other runs are matched.
    other = _SPACES.replace(r"\s", r"\t-\r")
    return F.lower(F.trim(F.regexp_replace(text, F.lit(rf"[{other}]{_S}*| {_S}+"), F.lit(" "))))


def _guarded(needs: tuple[str, ...], pattern: str, to: str):
    def step(text: Column) -> Column:
        able = text.contains(needs[0])
        for literal in needs[1:]:
            able = able | text.contains(literal)
        return F.when(able, F.regexp_replace(text, F.lit(pattern), F.lit(to))).otherwise(text)

    return step


def for_sparse(reason: Column) -> Column:
    """SC02: the ordered substitutions before sparse tokens are taken."""
    return F.trim(_steps(F.coalesce(reason, F.lit("")), SPARSE_STEPS))


def sparse_tokens(reason: Column) -> Column:
    """SC03: lower-cased tokens of two or more characters, from letters on."""
    return F.transform(F.regexp_extract_all(for_sparse(reason), F.lit("([a-zA-Z][a-zA-Z0-9]{1,})"), F.lit(1)), lambda t: F.lower(t))


def mask_numbers(text: Column) -> Column:
    """SC04: numbers with a unit of time become <TIME>, other standing numbers <NUM>."""
    text = F.regexp_replace(text, F.lit(rf"(?diu)(?<!{_W}){_D}+(?:\.{_D}+)?{_S}*(h|hr|hrs|m|min|s|sec|ms)(?!{_W})"), F.lit("<TIME>"))
    return F.regexp_replace(text, F.lit(rf"(?<!{_W})({_D}+(\.{_D}+)?)(?!{_W})"), F.lit("<NUM>"))


def trimmed(text: Column) -> Column:
    """SC05: texts over the cap keep head and tail."""
    return F.when(F.length(text) > TRIM_CAP, F.concat(F.substring(text, 1, TRIM_HEAD), F.lit(" ... "), F.right(text, F.lit(TRIM_TAIL)))).otherwise(text)


def without_controls(text: Column) -> Column:
    """SC06: control characters other than tab, LF and CR, and the two non-characters, are removed."""
    return F.regexp_replace(text, F.lit(r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F￾￿]"), F.lit(""))


def without_timestamp(line: Column) -> Column:
    """SC10."""
    return F.regexp_replace(line, F.lit(TIMESTAMP_PREFIX), F.lit(""))


def error_lines(message: Column) -> Column:
    """SC07: quoted items, else lines, that carry an error mark, once each (timestamps aside); none: the message."""
    quoted = F.regexp_extract_all(message, F.lit("'([^']*?)'"), F.lit(1))
    items = F.when(F.size(quoted) > 0, quoted).otherwise(F.split(message, "\n"))
    marked = F.filter(items, lambda x: x.rlike(r"(?i)<e>|\[ ?error ?\]"))
    keys = F.array_distinct(F.transform(marked, lambda x: F.trim(without_timestamp(F.trim(x)))))
    return F.when(F.size(marked) > 0, F.array_join(keys, "\n")).otherwise(message)


def error_segments(log: Column, size: int = 250, overlap: int = 50) -> Column:
    """SC08: what five patterns find in overlapping windows, once each, joined by spaces; none: empty."""
    text = F.replace(log, F.lit("\\n"), F.lit("\n"))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda at: F.substr(text, at + 1, F.lit(size)))
    found = F.flatten(F.transform(windows, lambda w: F.concat(*[F.regexp_extract_all(w, F.lit(f"(?i)({p})"), F.lit(1)) for p in ERROR_PATTERNS])))
    return F.array_join(F.array_distinct(found), " ")


def emptiness(text: Column) -> Column:
    """SC09/F03: NULL-like texts have no log, texts without a letter an empty one, others are ungrouped (NULL)."""
    return F.when(F.lower(F.trim(F.coalesce(text, F.lit("nan")))).isin("nan", "none", "null", ""), "NoErrorLog").when(~text.rlike("[a-zA-Z]"), "EmptyErrorLog")


def named_rule(text: Column) -> Column:
    """the last of six named patterns that matches."""
    out: Column | None = None
    for name, pattern in reversed(NAMED_RULES):
        out = F.when(text.rlike(f"(?i){pattern}"), name) if out is None else out.when(text.rlike(f"(?i){pattern}"), name)
    return out


def garbage_rule(kind: Column, text: Column) -> Column:
    """garbage output of one type of test."""
    return (kind == GARBAGE_TYPE) & F.coalesce(text.contains(GARBAGE_PHRASES[0]) | text.contains(GARBAGE_PHRASES[1]), F.lit(False))


def is_noise(text: Column, more: tuple[str, ...] = ()) -> Column:
    """blank, or infrastructure noise."""
    return text.isNull() | (F.trim(text) == "") | text.rlike("(?i)" + "|".join([*NOISE, *more]))


def length_bin(text: Column) -> Column:
    """Right-closed bins of text length: (0,50] and (50,110]; none beyond."""
    n = F.length(text)
    return F.when((n > 0) & (n <= 50), "(0,50]").when((n > 50) & (n <= 110), "(50,110]")


def cluster_key(cluster: Column, kind: Column, runtime: Column) -> Column:
    """SC18: the first ten hex digits of the MD5 of the three names."""
    return F.substring(F.md5(F.concat_ws("_", cluster, kind, runtime)), 1, 10)
