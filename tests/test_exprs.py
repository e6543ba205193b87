import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from hostlens.functions import exprs as ex


def column(spark, values, build, kind="double"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.t for r in frame.select("i", build(F.col("v")).alias("t")).orderBy("i").collect()]


def test_one_decimal_rounds_like_c(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 100_000) / 100 for _ in range(3000)] + [rng.uniform(-1000, 1000) for _ in range(1000)]
    values += [0.25, 0.35, 0.45, 0.05, 2.675, 0.0, -0.04, 99.95, 1e9 + 0.25, 123456789.05]
    assert column(spark, values, ex.one_decimal) == [f"{v:.1f}" for v in values]
    assert column(spark, values, ex.signed_one_decimal) == [f"{v:+.1f}" for v in values]


def test_general_number(spark):
    values = [80.0, 0.0, 52428800.0, 12.5, 0.5, 1e-7, 123456.0, 1234567.0, 99.9999]
    assert column(spark, values, ex.general_number) == [f"{v:g}" for v in values]


def test_byte_texts(spark):
    sizes = [0.0, 1023.0, 1024.0, 9.96 * 1024, 10.9 * 1024, 5 * 1024.0**2, 300 * 1024.0**3, 5000 * 1024.0**3]
    assert column(spark, sizes, ex.report_bytes) == [
        "0 B", "1023 B", "1.0 KB", "10.0 KB", "10 KB", "5.0 MB", "300 GB", "5000.0 GB"
    ]
    assert column(spark, [*sizes, None], ex.format_bytes) == [
        "0 B", "1,023 B", "1.0 KB", "10.0 KB", "11 KB", "5.0 MB", "300 GB", "4.9 TB", "—"
    ]


def test_values_and_bands(spark):
    def shown(metric, value):
        return column(spark, [value], lambda v: ex.format_value(F.lit(metric), v))[0]

    assert shown("cpu_percent", 12.34) == "12.3%"
    assert shown("memory_rss", 2048.0) == "2.0 KB"
    assert shown("other", 1.25) == "1.2"
    assert shown("cpu_percent", None) == "—"
    assert column(spark, [80.0, 50.0, 49.9, None], lambda v: ex.value_state(F.lit("cpu_percent"), v)) == [
        "critical", "elevated", "normal", "normal"
    ]
    assert column(spark, [60.0, 30.0, 29.0], lambda v: ex.value_state(F.lit("memory_percent"), v)) == [
        "critical", "elevated", "normal"
    ]


def test_rule_texts(spark):
    assert column(spark, [1536.0], lambda v: ex.rule_condition_text(F.lit("memory_rss"), F.lit("lte"), v)) == ["RSS ≤ 1.5 KB"]
    assert column(spark, [80.0], lambda v: ex.rule_condition_text(F.lit("cpu_percent"), F.lit("gt"), v)) == ["CPU > 80.0%"]
    assert column(spark, [0.0, 45.0, 90.0, 5400.0], ex.duration_text) == ["immediately", "45 sec", "1.5 min", "1.5 hr"]


def test_clock_texts(spark):
    stamps = [1_700_000_000.0, 1_700_000_000.25]
    wanted = [datetime.fromtimestamp(s, tz=timezone.utc).isoformat() for s in stamps]
    assert column(spark, [*stamps, None], ex.utc_iso) == [*wanted, None]
    assert column(spark, [1_700_000_000.99, None], ex.fmt_time) == ["22:13:20", "—"]
    now = 1_700_000_000.0
    ages = [0, 4, 5, 59, 60, 3599, 3600, 86_400, -30]
    assert column(spark, [now - a for a in ages] + [None], lambda v: ex.relative_time(v, now)) == [
        "just now", "just now", "5s ago", "59s ago", "1m ago", "59m ago", "1h ago", "1d ago", "just now", "never"
    ]


def test_freshness_and_operators(spark):
    assert column(spark, [90.0, 90.1, 900.0, 901.0], lambda v: ex.freshness(v, 90, 900)) == ["live", "stale", "stale", "offline"]
    for op, wanted in {"gt": [0, 0, 1], "gte": [0, 1, 1], "lt": [1, 0, 0], "lte": [1, 1, 0], "eq": [0, 1, 0], "x": [0, 0, 0]}.items():
        found = column(spark, [1.0, 2.0, 3.0], lambda v, op=op: ex.matches(F.lit(op), v, F.lit(2.0)))
        assert found == [bool(w) for w in wanted]


def test_search_wildcards_and_backslashes(spark):
    names = ["Alpha", "a_b", "axb", "50%", "c:\\x", None]

    def found(needle):
        frame = spark.createDataFrame([(n,) for n in names], "v string")
        return [r.v for r in frame.filter(ex.contains_like(needle, "v")).collect()]

    assert found("ALPH") == ["Alpha"]
    assert found("a_b") == ["a_b", "axb"]
    assert found("\\") == ["c:\\x"]
    assert found(":\\x") == ["c:\\x"]
