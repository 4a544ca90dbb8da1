"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import vocab


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, instead of repeating its code."""
    return F.element_at(F.transform(F.array(value), body), 1)


def confidence_rank(resolution: Column) -> Column:
    """exact 0, inferred 1, unresolved 2; a missing resolution counts as exact."""
    rank = F.when(resolution == "inferred", 1).when(resolution == "unresolved", 2)
    return rank.otherwise(0)


def confidence_label(rank: Column) -> Column:
    return F.when(rank >= 2, "unresolved").when(rank == 1, "inferred").otherwise("exact")


def owner_of(name: Column) -> Column:
    """``a.b.c`` -> ``a.b``; NULL when there is no dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def last_segment(name: Column, separators: Iterable[str] = (".",)) -> Column:
    for separator in separators:
        name = F.substring_index(name, separator, -1)
    return name


def dotted_suffixes(name: Column) -> Column:
    """Every proper or improper suffix that starts at a ``.`` boundary: a.b.c -> [a.b.c, b.c, c].

    Exploding these turns an ``endswith('.' + x)`` theta join into an equi-join.
    """
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def dotted_prefixes(name: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def risk_band(score: Column) -> Column:
    band = None
    for label, floor in vocab.RISK_BANDS:
        band = F.when(score >= floor, label) if band is None else band.when(score >= floor, label)
    return band.otherwise("LOW")


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def layer_of_role(role: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(vocab.ROLE_TO_LAYER), role), F.lit("unknown"))


def transition_allowed(source_layer: Column, target_layer: Column) -> Column:
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in vocab.ALLOWED_TRANSITIONS])
    either_unknown = (source_layer == "unknown") | (target_layer == "unknown")
    return either_unknown | F.array_contains(pairs, F.concat(source_layer, F.lit(">"), target_layer))


def http_path(path: Column) -> Column:
    """Collapse repeated slashes, force a leading slash, drop a trailing one."""
    collapsed = F.regexp_replace(F.trim(path), "/+", "/")
    rooted = F.regexp_replace(collapsed, "^(?!/)", "/")
    return F.regexp_replace(rooted, "(.)/$", "$1")


def http_path_key(path: Column) -> Column:
    """Path with every parameter notation replaced by ``{_}``, for matching calls to routes."""
    key = http_path(path)
    for pattern in (r"\{[a-zA-Z0-9_]+\}", r"<([a-zA-Z0-9_]+:)?[a-zA-Z0-9_]+>", r":([a-zA-Z0-9_]+)"):
        key = F.regexp_replace(key, pattern, "{_}")
    return key


def cosine_similarity(left: Column, right: Column) -> Column:
    """1 - cosine distance, in double precision; NULL when either vector is all zeros."""
    a = left.cast("array<double>")
    b = right.cast("array<double>")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norms > 0, dot / norms)


def with_group_max(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Attach the maximum of ``value`` per group.

    A two-step aggregate and join, not a window: a window over a snapshot would pull the whole
    snapshot into one task, while this combines map-side and joins one row per group.
    """
    top = df.groupBy(*keys).agg(F.max(value).alias(out))
    return df.join(top, keys, "left")


def max_normalised(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """``value / max(value)`` per group, 0 where the maximum is 0."""
    scaled = with_group_max(df, value, "_top", keys)
    ratio = F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.lit(0.0))
    return scaled.withColumn(out, ratio).drop("_top")


def percentile_rank(df: DataFrame, value: str, out: str, keys: list[str]) -> DataFrame:
    """Share of rows with a value <= this row's, times 100, per group.

    Ranks the histogram of distinct values instead of the rows: the window then sees one row per
    distinct value, which for degrees is at most about the square root of twice the edge count.
    """
    from pyspark.sql import Window

    histogram = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = histogram.select(
        *keys, value,
        (F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
         / F.sum("_n").over(w) * 100.0).alias(out),
    )
    return df.join(ranked, [*keys, value], "left")
