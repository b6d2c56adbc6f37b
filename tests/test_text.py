import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import runs as R
from faultline.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("9: Error took 12.5ms\nnext [line]", "error took next line"),
        ("build version: 1.2, crash 'here'", "crash here"),
        ("  123 é failed\t\tnow ", "failed now"),
        (None, "nan"),
        ("", ""),
    ],
)
def test_preprocess(spark, raw, want):
    got = one(spark, T.preprocess, raw)
    assert got == want


def test_preprocess_caps_long_text(spark):
    assert len(one(spark, T.preprocess, "a" * 30_000)) == 6_000 + 5 + 14_000


def test_mask_numbers(spark):
    assert one(spark, T.mask_numbers, "took 12 ms, 3.5s and 42 of x7 y") == "took <TIME>, <TIME> and <NUM> of x7 y"


def test_trim_keeps_head_and_tail(spark):
    got = one(spark, T.trimmed, "h" * 3000 + "t" * 4000)
    assert len(got) == 5005 and got.startswith("h" * 1500 + " ... ")


def test_error_lines(spark):
    text = "2024-01-01T00:00:00 [ERROR] a\nfine\n2024-01-02T00:00:00 [ERROR] a\n<e> b"
    assert one(spark, T.error_lines, text) == "[ERROR] a\n<e> b"
    assert one(spark, T.error_lines, "nothing here") == "nothing here"


def test_error_segments_match_definition(spark):
    text = ("x" * 190 + " Error: one\\nTraceback two " + "y" * 300 + " error three") * 2
    whole = text.replace("\\n", "\n")
    found = []
    for at in range(0, len(whole), 200):
        for p in T.ERROR_PATTERNS:
            found += re.findall(p, whole[at : at + 250], flags=re.I)
    assert one(spark, T.error_segments, text) == " ".join(dict.fromkeys(found))


def test_named_rules_last_wins(spark):
    assert one(spark, T.named_rule, "Verifier failed then WAIT TIMEOUT") == "Wait timeout"


def test_run_ids(spark):
    got = one(spark, R.parse, "ALFA-v2.40.0.250920042144_127164-pt_alt_RC2")
    assert (got["version"], got["timestamp"], got["suffix_base"], got["is_rc"], got["rc"]) == ("2.40.0", "250920042144", "pt_alt", True, 2)
    assert one(spark, R.parse, "nonsense") is None
    assert str(one(spark, R.embedded_time, "x_20250131235959_y")) == "2025-01-31 23:59:59"
    assert one(spark, R.embedded_time, "x_999999999999") is None
