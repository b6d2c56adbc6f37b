"""Run ids: their parts, embedded times, segments and order, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of a run id, in order: with a build, with a build of another platform, without one, and whatever else names
# a version and a stamp (its build ends at a hyphen, else at an underscore).
_HEAD = r"^([A-Za-z_]+)-v(\d+\.\d+\.\d+)\.(\d{12,14})"
FORMS = (rf"{_HEAD}_(\d+)()-(.+)$", rf"{_HEAD}_(\d+)(_win)-(.+)$", rf"{_HEAD}()()-(.+)$", r"^(.+?)-v(\d+\.\d+\.\d+)\.?(\d{12,14})_([^-]*)()-(.*)$", r"^(.+?)-v(\d+\.\d+\.\d+)\.?(\d{12,14})_([^-_]*)()_?([^-]*)$")
# Ordered segment patterns.
SEGMENTS = (("Compute", r"(?:^|[^a-z0-9])win(?:dows)?(?:[^a-z0-9]|$)"), ("Auto", r"(?:^|[^a-z0-9])auto(?:[^a-z0-9]|$)"), ("GenAI", r"(?:^|[^a-z0-9])llm(?:[^a-z0-9]|$)"), ("Mobile/IOT/XR", r"(?:^|[^a-z0-9])pt(?:[^a-z0-9]|$)"))


def parse(run: Column) -> Column:
    """SC11: the parts as a struct, by the first form that matches; NULL if none does."""

    def by(form: str) -> Column:
        part = lambda k: F.regexp_extract(run, form, k)
        suffix, version = part(6), F.split(part(2), r"\.")
        rc = F.regexp_extract(suffix, r"_RC(\d+)", 1)
        return F.struct(
            part(1).alias("prefix"),
            part(2).alias("version"),
            part(3).alias("timestamp"),
            F.concat(part(4), part(5)).alias("build_number"),
            suffix.alias("suffix"),
            F.regexp_replace(suffix, r"_RC.*$", "").alias("suffix_base"),
            suffix.contains("_RC").alias("is_rc"),
            version[0].cast("int").alias("major"),
            version[1].cast("int").alias("minor"),
            F.when(rc != "", rc.cast("int")).otherwise(0).alias("rc"),
        )

    return F.coalesce(*[F.when(run.rlike(form), by(form)) for form in FORMS])


def failed_runs(log: Column) -> Column:
    """SC38: the run ids that a log of failed runs names, in order."""
    found = F.regexp_extract_all(log, F.lit(r"(?m)^Run ID:[ \t]*(.+)$"), F.lit(1))
    return F.filter(F.transform(found, lambda r: F.trim(r)), lambda r: r != "")


def embedded_time(run: Column) -> Column:
    """SC12: the first token of 12 to 14 digits that is a time: 14 digits with a full year, else its first or last 12."""
    tokens = F.regexp_extract_all(run, F.lit(r"(\d{12,14})"), F.lit(1))

    def one(token: Column) -> Column:
        long = F.when(F.length(token) == 14, F.try_to_timestamp(token, F.lit("yyyyMMddHHmmss")))
        return F.coalesce(long, F.try_to_timestamp(F.substring(token, 1, 12), F.lit("yyMMddHHmmss")), F.try_to_timestamp(F.right(token, F.lit(12)), F.lit("yyMMddHHmmss")))

    return F.try_element_at(F.filter(F.transform(tokens, one), lambda t: t.isNotNull()), F.lit(1))


def embedded_date(run: Column) -> Column:
    """SC13: the date of a 12-digit stamp behind a three-part version."""
    stamp = F.regexp_extract(run, r"-v\d+\.\d+\.\d+\.(\d{12})_", 1)
    return F.to_date(F.try_to_timestamp(F.when(stamp != "", F.substring(stamp, 1, 6)), F.lit("yyMMdd")))


def segment(run: Column) -> Column:
    """SC15: the first delimited mark that the lower-cased id has."""
    low = F.lower(run)
    out = F.when(low.rlike(SEGMENTS[0][1]), SEGMENTS[0][0])
    for name, pattern in SEGMENTS[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("Unknown")


def segment_by_substring(run: Column) -> Column:
    """SC16: the dashboard's variant, by plain substrings."""
    low = F.lower(run)
    return F.when(low.contains("win"), "win").when(low.contains("auto"), "auto").when(low.contains("llm"), "llm").when(low.contains("pt"), "pt").otherwise("Unknown")


def release_rewrite(run: Column, version: str, rc: int | None = None) -> Column:
    """SC19: the id of another release: without its RC, with the first version segment replaced, with the new RC."""
    base = F.regexp_replace(F.regexp_replace(run, r"_RC\d+$", ""), r"^([^v]*-v)\d+\.\d+\.\d+", "$1" + version)
    return F.concat(base, F.lit(f"_RC{rc}")) if rc is not None else base


def elapsed_label(seconds: Column) -> Column:
    """SC21: 2h 15m, or 1d 3h from a day on."""
    minutes = F.floor(seconds / 60)
    days, hours = F.floor(minutes / 1440), F.floor(minutes / 60)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), (hours - 24 * days).cast("string"), F.lit("h"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), (minutes - 60 * hours).cast("string"), F.lit("m")))


def backoff_seconds(attempt: Column) -> Column:
    """SC22."""
    return F.least(F.lit(30), F.lit(5) * F.pow(F.lit(2), attempt - 1)).cast("int")
