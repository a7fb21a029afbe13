"""Sampling, resampling, splits, folds and row ids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.hashing import hash_bucket, hash_fold, uniform
from sluiceway.functions.parsing import as_column
from sluiceway.operators.stats import class_counts
from sluiceway.sources.workspace import lineage_cut
from sluiceway.specs import RESAMPLE_CAP, RESAMPLE_RATIOS, Split


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample without replacement; the table itself at 1.0."""
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    return df if fraction == 1.0 else df.sample(False, fraction, seed)


def sample_by(df: DataFrame, key: str, fractions: dict, seed: int = 42) -> DataFrame:
    """Per-class Bernoulli sample; a class without a fraction is left out. No prior count.

    The class filter reaches the scan; the draw is an expression like any other.
    """
    if not fractions:
        return df.limit(0)
    limit = None
    for name, fraction in fractions.items():
        branch = (as_column(key) == F.lit(name), F.lit(float(fraction)))
        limit = F.when(*branch) if limit is None else limit.when(*branch)
    return df.filter(as_column(key).isin(list(fractions))).filter(F.rand(seed) < limit)


LARGEST_RATE = 30.0


# -- resampling to class targets --------------------------------------------

def resample_plan(
    df: DataFrame, key: str, ratios: dict[str, float] | None = None, cap: float = RESAMPLE_CAP
) -> DataFrame:
    """Per class: rows, target and sampling fraction.

    The target is ``ratio * largest class``; a class without a ratio keeps its rows.
    """
    ratios = RESAMPLE_RATIOS if ratios is None else ratios
    counts = class_counts(df, [key])
    largest = counts.agg(F.max("rows")).scalar()
    ratio = F.lit(None).cast("double")
    for name, value in ratios.items():
        ratio = F.when(F.col(key) == F.lit(name), F.lit(float(value))).otherwise(ratio)
    target = F.coalesce(largest * ratio, F.col("rows").cast("double"))
    return counts.select(key, "rows", target.alias("target")).withColumn(
        "fraction", F.least(F.col("target") / F.col("rows"), F.lit(float(cap)))
    )


def resample_fractions(
    df: DataFrame, key: str, ratios: dict[str, float] | None = None, cap: float = RESAMPLE_CAP
) -> dict[str, float]:
    """Fractions of the classes that have a ratio; at most as many rows as ``ratios``."""
    ratios = RESAMPLE_RATIOS if ratios is None else ratios
    plan = resample_plan(df, key, ratios, cap).filter(F.col(key).isin(list(ratios)))
    return {r[key]: r["fraction"] for r in plan.collect()}


def _poisson_steps(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, … up to where double precision reaches 1."""
    p = math.exp(-rate)
    total, k, steps = p, 0, []
    while total < 1.0 and p > 1e-18:
        steps.append(total)
        k += 1
        p *= rate / k
        total += p
    return steps


def _copies(fraction: float, draw: Callable[[int], Column], mode: str) -> Column:
    """Number of copies; ``draw(i)`` is the i-th independent uniform value of a row."""
    u = draw(0)
    if mode == "whole":
        whole = math.floor(fraction)
        return F.lit(whole) + (u < F.lit(fraction - whole)).cast("int")
    if fraction < 1.0:
        return (u < F.lit(fraction)).cast("int")
    # Number of steps of the Poisson distribution function that the draw reaches. A large rate is
    # a sum of equal ones, each small enough for its steps to be exact.
    parts = math.ceil(fraction / LARGEST_RATE)
    steps = _poisson_steps(fraction / parts)
    return _sum([(draw(i) >= F.lit(s)).cast("int") for i in range(parts) for s in steps])


def _sum(terms: list[Column]) -> Column:
    """A balanced sum, so that many terms don't make a deep expression."""
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else _sum(terms[:half]) + _sum(terms[half:])


def resample_to_target(
    df: DataFrame,
    key: str,
    ratios: dict[str, float] | None = None,
    cap: float = RESAMPLE_CAP,
    row_key: list[str] | None = None,
    mode: str = "poisson",
    seed: int = 42,
    portable: bool = False,
) -> DataFrame:
    """Bring classes towards their targets in one narrow pass, without a shuffle.

    Every row gets a number of copies by its class: a Poisson draw where the fraction is
    >= 1 (sampling with replacement), a Bernoulli draw below 1. ``mode="whole"`` gives
    ``floor(fraction)`` sure copies plus one more with the remaining probability, so no
    original row of an enlarged class is lost. With ``row_key`` the draw is a hash of those
    columns, so a retried task draws the same; without, it is ``rand``.
    ``mode="per_class"`` is the per-class filter / sample / union form.
    """
    if mode not in ("poisson", "whole", "per_class"):
        raise ValueError("mode must be 'poisson', 'whole' or 'per_class'")
    fractions = resample_fractions(df, key, ratios, cap)
    listed = as_column(key).isin(list(fractions))
    if mode == "per_class":
        parts = [
            df.filter(as_column(key) == F.lit(name)).sample(f >= 1.0, f, seed)
            for name, f in fractions.items()
        ]
        rest = df.filter(~listed).sample(True, 1.0, seed)
        return reduce(DataFrame.union, [*parts, rest])
    def fresh(i: int) -> Column:
        own = seed + i
        return uniform(*row_key, seed=own, portable=portable) if row_key else F.rand(own)

    def draw(i: int) -> Column:
        return F.col("__u") if i == 0 else fresh(i)

    copies = None
    for name, f in fractions.items():
        branch = (as_column(key) == F.lit(name), _copies(f, draw, mode))
        copies = F.when(*branch) if copies is None else copies.when(*branch)
    unlisted = _copies(1.0, draw, mode)
    copies = unlisted if copies is None else copies.otherwise(unlisted)
    drawn = df.filter(as_column(key).isNotNull()).withColumn("__u", fresh(0))
    return (
        drawn.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .drop("__u", "__copy")
    )


# -- splits and folds -------------------------------------------------------

def split_random(df: DataFrame, split: Split) -> dict[str, DataFrame]:
    """Random split into named parts; depends on the partitioning of the input."""
    frames = df.randomSplit(list(split.parts.values()), split.seed)
    return dict(zip(split.parts, frames, strict=True))


def _part_of(position: Column, split: Split, whole: int | float) -> Column:
    """Name of the part that a position in [0, whole) falls into."""
    names = list(split.parts)
    out, edge = None, 0.0
    for name in names[:-1]:
        edge += split.parts[name]
        limit = round(edge * whole) if isinstance(whole, int) else edge * whole
        branch = (position < F.lit(limit), F.lit(name))
        out = F.when(*branch) if out is None else out.when(*branch)
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def split_column(key: Column | str, split: Split, buckets: int = 100) -> Column:
    """Name of the part a key falls into, by hash bucket; seed and parts salt the hash."""
    return _part_of(hash_bucket(key, buckets=buckets, salt=split.salt), split, buckets)


def split_by_row(
    df: DataFrame, split: Split, name: str = "split", skip: tuple[str, ...] = ()
) -> DataFrame:
    """Add the part name by a hash of the row's columns; equal rows share a part."""
    u = uniform(*[c for c in df.columns if c not in skip], seed=split.seed)
    return df.withColumn(name, _part_of(u, split, 1.0))


def split_drawn(df: DataFrame, split: Split, name: str = "split") -> DataFrame:
    """Add the part name by a random draw per row. Write or checkpoint the result before it
    is used more than once, which freezes the draws."""
    return df.withColumn(name, _part_of(F.rand(split.seed), split, 1.0))


def split_hash(df: DataFrame, key: str, split: Split, name: str = "split") -> DataFrame:
    """Add the part name by key hash: one pass, same result for any partitioning."""
    return df.withColumn(name, split_column(key, split))


def split_parts(df: DataFrame, key: str, split: Split) -> dict[str, DataFrame]:
    """The parts of ``split_hash`` as separate DataFrames."""
    tagged = split_hash(df, key, split, "__split")
    return {p: tagged.filter(F.col("__split") == p).drop("__split") for p in split.parts}


def hash_folds(
    df: DataFrame, key: str, k: int, name: str = "fold", portable: bool = False, seed: int = 42
) -> DataFrame:
    """Add a fold number 0 … k-1 by key hash, salted with ``#fold`` and the seed."""
    fold = (hash_bucket(key, buckets=k, salt=f"#fold{seed}") if portable
            else hash_fold(key, k=k, seed=seed))
    return df.withColumn(name, fold.cast("int"))


def held_out(key: str, group: object) -> Column:
    """Whether a row belongs to the group; rows without a group belong to none."""
    return as_column(key).eqNullSafe(F.lit(group))


def leave_one_group_out(
    df: DataFrame, key: str, groups: list
) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """(group, all other rows, rows of the group) for each group; persist the table first.

    Rows without a group are training rows of every group.
    """
    for g in groups:
        yield g, df.filter(~held_out(key, g)), df.filter(held_out(key, g))


def held_out_totals(df: DataFrame, key: str, sums: dict[str, Column], again: dict[str, Column]
                    ) -> DataFrame:
    """(holdout, part, totals ...) for every group of the data, from one pass over the table.

    ``sums`` are aggregates per group, ``again`` those that combine them, by the same names.
    Every group's totals count once for each holdout; a null group is a training part of all.
    """
    per = df.groupBy(as_column(key).alias("__group")).agg(
        *[c.alias(n) for n, c in sums.items()])
    groups = per.agg(F.collect_set("__group")).scalar()
    each = per.withColumn("holdout", F.explode(groups))
    part = F.when(F.col("__group").eqNullSafe(F.col("holdout")), "test").otherwise("train")
    return each.groupBy("holdout", part.alias("part")).agg(
        *[c.alias(n) for n, c in again.items()])


def add_row_id(
    df: DataFrame, name: str = "row_id", stable: bool = True, spread: bool = False
) -> DataFrame:
    """Unique row number. ``stable`` writes the result to the shared folder, so that a
    retried task cannot number rows anew; prefer a natural key where there is one.
    ``spread`` evens out the numbered rows by size."""
    out = df.withColumn(name, F.monotonically_increasing_id())
    return lineage_cut(out, spread=spread) if stable else out
