"""Row predicates and interval arithmetic on events, as column expressions that Catalyst can push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(machine: str | None = None, process: str | None = None, phase: str | None = None, category: str | None = None) -> Column:
    """Rows of a machine, process, phase or category; what is not given does not matter."""
    out = F.lit(True)
    for name, value in {"machine": machine, "process": process, "phase": phase, "category": category}.items():
        out = out if value is None else out & (F.col(name) == value)
    return out


def categories(keep: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    if keep is not None and ignore is not None:
        raise ValueError("give keep or ignore, not both")
    if keep is not None:
        return F.col("category").isin(*keep)
    return ~F.col("category").isin(*ignore) if ignore is not None else F.lit(True)


def contained(lo: int | None = None, hi: int | None = None) -> Column:
    """Events inside a time range, open on a side that is not given."""
    out = F.lit(True)
    out = out if lo is None else out & (F.col("start_us") >= lo)
    return out if hi is None else out & (F.col("end_us") <= hi)


def in_split(lo: int, hi: int) -> Column:
    """Events with any part in a range: inside, over an edge, or all around it."""
    return (F.col("start_us") <= hi) & (F.col("end_us") >= lo)


def touches_end(lo: int, hi: int) -> Column:
    """Events of which the start or the end is in a range."""
    return F.col("start_us").between(lo, hi) | F.col("end_us").between(lo, hi)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column, kind: str = "any") -> Column:
    """``any``: a shared instant; ``subsumes``: the first holds the second; ``partial``: overlapping, but not held."""
    held = (s1 <= s2) & (e2 <= e1)
    shared = (s1 <= e2) & (s2 <= e1)
    return {"any": shared, "subsumes": held, "partial": shared & ~held & ~((s2 <= s1) & (e1 <= e2))}[kind]


def clipped(lo: int, hi: int) -> list[Column]:
    """Start and end of events cut to a window."""
    return [F.greatest(F.col("start_us"), F.lit(lo)).alias("start_us"), F.least(F.col("end_us"), F.lit(hi)).alias("end_us")]


def negative_dropped(events: DataFrame) -> DataFrame:
    return events.filter("end_us >= start_us")


def negative_clamped(events: DataFrame) -> DataFrame:
    return events.withColumn("end_us", F.greatest("start_us", "end_us"))


#: Words by which the name of a CPU is known.
CPU_WORDS = ["Intel", "Xeon", "CPU", "AMD"]


def is_cpu(device: Column) -> Column:
    return device.rlike(rf"(?i)\b({'|'.join(CPU_WORDS)})\b")


def to_seconds(df: DataFrame) -> DataFrame:
    """Every ``…_us`` column in seconds, as ``…_sec``."""
    return df.select(*[(F.col(c) / 1e6).alias(f"{c[:-3]}_sec") if c.endswith("_us") else F.col(c) for c in df.columns])


def with_suffix(df: DataFrame, suffix: str, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in columns})


def human_micros(text: Column) -> Column:
    """Microseconds of times such as ``1.5ms``, ``20us``, ``3ns`` or ``2s``; null for anything else."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*(ns|us|ms|s)\s*$", 1), F.regexp_extract(text, r"(ns|us|ms|s)\s*$", 1)
    scale = F.when(unit == "ns", 1e-3).when(unit == "us", 1.0).when(unit == "ms", 1e3).when(unit == "s", 1e6)
    return number.try_cast("double") * scale


def joined(values: Column, sep: str = " + ") -> Column:
    return F.array_join(values, sep)


def pretty_micros(us: Column) -> Column:
    """Microseconds as text in the largest unit that gives 1 or more, with two decimals: ``1.50 ms``."""
    scales = {"s": 1e6, "ms": 1e3, "us": 1.0}
    return F.coalesce(*[F.when(F.abs(us) >= x, F.format_string(f"%.2f {unit}", us / x)) for unit, x in scales.items()], F.format_string("%.2f ns", us * 1000.0))


def function_name(name: Column) -> Column:
    """A Python function's name without its file's folders and without line numbers."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\s:(]*/", ""), r":[0-9]+", "")


def numbers_where_possible(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of which every non-null value is a whole number become long, those of numbers double; others stay.

    One aggregation over all rows decides.
    """
    checks = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"{c}:{t}") for c in columns for t in ("bigint", "double")]
    bad = df.agg(*checks).first() if columns else {}
    kinds = {c: next((t for t in ("bigint", "double") if bad[f"{c}:{t}"] == 0), None) for c in columns}
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if t})


def merged_interval(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The smallest interval around both, as struct<start_us, end_us>."""
    return F.struct(F.least(s1, s2).alias("start_us"), F.greatest(e1, e2).alias("end_us"))


def common_interval(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """What both have in common; null if they share no instant."""
    return F.when((s1 <= e2) & (s2 <= e1), F.struct(F.greatest(s1, s2).alias("start_us"), F.least(e1, e2).alias("end_us")))


def order(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """``before``, ``after``, ``equal`` or ``overlap``: where the first lies to the second."""
    return F.when(e1 < s2, "before").when(e2 < s1, "after").when((s1 == s2) & (e1 == e2), "equal").otherwise("overlap")


def selected(df: DataFrame, wanted: dict[str, object], order: list[str]) -> DataFrame:
    """Rows of an index of reports: by field a value that it equals, or a function from its column to a condition; then ordered."""
    for field, want in wanted.items():
        df = df.filter(want(F.col(field)) if callable(want) else F.col(field).eqNullSafe(F.lit(want)))
    return df.orderBy(*order)
