"""Performance scores: times out of the nested text that a test stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "Execution_Data map<string,map<string,struct<Avg_Time:string,Min_Time:string>>>"
# The entries of a runtime, in order of preference; the second set is that of the other product line.
INFERENCE = (("Total Inference Time 75P", "Total Inference Time"), ("Total Inference Time 75P", "Total Inference Time [NetRun]"))
INIT = ("Init", "Init Stats [NetRun]")
DEINIT = ("De-Init", "De-Init Stats [NetRun]")


def parse(score: Column, second: Column) -> Column:
    """SC30: (inference, init, deinit) as doubles, of the first runtime that the text names; `second` tells rows of the
    other product line. The text is JSON, or the same with single quotes and None; whatever is missing, None or no
    number is NULL (an unusable 75th percentile gives way to the average of all)."""
    text = F.replace(F.replace(score, F.lit("'"), F.lit('"')), F.lit("None"), F.lit('"None"'))
    runtimes = F.map_values(F.from_json(text, SCHEMA)["Execution_Data"])
    first = F.try_element_at(runtimes, F.lit(1))

    def value(names: tuple[str, ...], field: str) -> Column:
        return F.coalesce(*[F.try_element_at(first, F.lit(n))[field].try_cast("double") for n in names])

    def either(pick: tuple, field: str) -> Column:
        a, b = (p if isinstance(p, tuple) else (p,) for p in pick)
        return F.when(second, value(b, field)).otherwise(value(a, field))

    return F.struct(either(INFERENCE, "Avg_Time").alias("inference"), either(INIT, "Min_Time").alias("init"), either(DEINIT, "Min_Time").alias("deinit"))
