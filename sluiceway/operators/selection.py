"""Ranking of vector features by a test against the label, fitted once for any number of choices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.parsing import as_column


@dataclass(frozen=True)
class Ranking:
    """Feature numbers, best first."""

    order: tuple[int, ...]

    def best(self, k: int) -> list[int]:
        """The k best in ascending order, as a selector puts them; all if there are fewer."""
        if k < 1:
            raise ValueError("at least one feature has to be selected")
        return sorted(self.order[:k])

    def slicer(self, k: int, features: str = "features", out: str = "sel_features") -> VectorSlicer:
        return VectorSlicer(inputCol=features, outputCol=out, indices=self.best(k))


def feature_values(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(feature, value, label), one row per vector element; null and NaN elements are null."""
    elements = vector_to_array(as_column(features)) if dict(df.dtypes)[features] == "vector" else (
        as_column(features).cast("array<double>"))
    out = df.select(as_column(label).alias("label"), F.posexplode(elements).alias("feature", "value"))
    return out.select("feature", F.nanvl("value", F.lit(None).cast("double")).alias("value"), "label")


def _cut_ranges(values: DataFrame, bins: int, accuracy: int) -> DataFrame:
    """(feature, cut, low, high, below, rank): a value range that surely holds the cut.

    Approximate quantiles on both sides of a rank give two edges, and exact counts at them tell whether
    the rank lies between, below or above; a null bound is open, and an edge beside it left out.
    """
    pad = 2.0 / accuracy
    shares = [i / bins for i in range(1, bins)]
    near = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-pad, pad)]
    edges = values.groupBy("feature").agg(F.percentile_approx("value", near, accuracy).alias("edges"))
    value, at = F.col("value"), F.col("edges").getItem
    counted = values.join(F.broadcast(edges), "feature").groupBy("feature").agg(  # as many rows as
        F.count("*").alias("n"), F.first("edges").alias("edges"),                 # the vector is wide
        F.array(*[F.count_if(value < at(2 * i)) for i in range(bins - 1)]).alias("lower"),
        F.array(*[F.count_if(value <= at(2 * i + 1)) for i in range(bins - 1)]).alias("upto"))

    def span(i: int) -> Column:
        rank = F.greatest(F.ceil(F.lit(shares[i]) * F.col("n")), F.lit(1))
        lower, upto = F.col("lower")[i], F.col("upto")[i]
        under, over = rank <= lower, rank > upto
        return F.struct(
            F.lit(i).alias("cut"), rank.alias("rank"), under.alias("under"), over.alias("over"),
            F.when(over, at(2 * i + 1)).when(~under, at(2 * i)).alias("low"),
            F.when(under, at(2 * i)).when(~over, at(2 * i + 1)).alias("high"),
            F.when(under, F.lit(0)).when(over, upto).otherwise(lower).alias("below"))

    spans = F.explode(F.array(*[span(i) for i in range(bins - 1)])).alias("s")
    return counted.select("feature", spans).select("feature", "s.*")


def quantile_cuts(values: DataFrame, bins: int, accuracy: int = 10_000) -> DataFrame:
    """(feature, cuts): ``bins - 1`` cut values per feature, exactly those at rank ceil(i n / bins).

    A rank is searched within a range of about 4 n / ``accuracy`` values, where equal ones count once,
    so no task sorts a feature. Only speed depends on the accuracy. Features without values have no row.
    """
    if bins < 2:
        raise ValueError("at least two bins are needed")
    some = values.filter(F.col("value").isNotNull()).select("feature", "value")
    ranges = F.broadcast(_cut_ranges(some, bins, accuracy))  # bins - 1 rows per feature
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    above = low.isNull() | (value > low) | ((value == low) & ~F.col("over"))
    under = high.isNull() | (value < high) | ((value == high) & ~F.col("under"))
    inside = some.join(ranges, "feature").filter(above & under)
    steps = inside.groupBy("feature", "cut", "rank", "below", "value").agg(F.count("*").alias("rows"))
    upto = F.col("below") + F.sum("rows").over(Window.partitionBy("feature", "cut").orderBy("value"))
    found = steps.withColumn("upto", upto).filter(F.col("upto") >= F.col("rank")).groupBy(
        "feature", "cut").agg(F.min("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("cut", "value")))
    return found.groupBy("feature").agg(F.transform(ordered, lambda s: s["value"]).alias("cuts"))


def value_bin(value: Column, cuts: Column, bins: int) -> Column:
    """How many cuts lie below the value; missing values have a bin of their own (-1).

    Repeated cuts skip numbers: a value that fills several quantiles is one bin.
    """
    below = F.lit(0)
    for i in range(bins - 1):
        below = below + (value > F.get(cuts, F.lit(i))).cast("int")
    return F.when(value.isNull(), F.lit(-1)).otherwise(below)


def contingency(df: DataFrame, features: str = "features", label: str = "label", bins: int = 10,
                accuracy: int = 10_000) -> DataFrame:
    """(feature, bin, label, rows): the occupied cells of all features, from one aggregate.

    Any real-valued feature will do, as values are cut at quantiles first. Rows without label are
    left out. Joined with the cuts (one row per feature), nothing is shuffled but the cells.
    """
    values = feature_values(df.filter(as_column(label).isNotNull()), features, label)
    cuts = quantile_cuts(values, bins, accuracy)
    binned = values.join(F.broadcast(cuts), "feature", "left")  # as many rows as the vector is wide
    return binned.groupBy("feature", value_bin(F.col("value"), F.col("cuts"), bins).alias("bin"), "label"
                          ).agg(F.count("*").alias("rows"))


def chi_square(cells: DataFrame) -> DataFrame:
    """(feature, rows, statistic, dof, score) of a contingency table of occupied cells.

    The statistic is n (sum of o^2 / (bin total * label total) - 1), so empty cells need no row.
    ``score`` is the cube-root normal score of the statistic (Wilson and Hilferty): it orders
    features with different degrees of freedom by significance and never underflows as p-values do.
    It is null for a feature with one bin or one label.
    """
    of = Window.partitionBy
    totals = cells.select(
        "feature", "rows",
        F.sum("rows").over(of("feature", "bin")).alias("in_bin"),
        F.sum("rows").over(of("feature", "label")).alias("in_label"),
        F.row_number().over(of("feature", "bin").orderBy("label")).alias("nth_of_bin"),
        F.row_number().over(of("feature", "label").orderBy("bin")).alias("nth_of_label"),
    )
    part = F.col("rows").cast("double") * F.col("rows") / (F.col("in_bin").cast("double") * F.col("in_label"))
    sums = totals.groupBy("feature").agg(
        F.sum("rows").alias("rows"), F.sum(part).alias("s"),
        ((F.count_if(F.col("nth_of_bin") == 1) - 1) * (F.count_if(F.col("nth_of_label") == 1) - 1))
        .cast("int").alias("dof"),
    )
    statistic = F.greatest(F.col("rows") * (F.col("s") - 1.0), F.lit(0.0))
    spread = F.lit(2.0) / (F.lit(9.0) * F.col("dof"))
    score = (F.cbrt(F.col("statistic") / F.col("dof")) - (1.0 - spread)) / F.sqrt(spread)
    return sums.select("feature", "rows", statistic.alias("statistic"), "dof").withColumn(
        "score", F.when(F.col("dof") > 0, score))


def chi_square_ranking(df: DataFrame, features: str = "features", label: str = "label",
                       bins: int = 10, accuracy: int = 10_000) -> DataFrame:
    """``chi_square`` of all features with their ``position`` from 1.

    Scores that agree in nine decimals are ties, which go by feature number, so that the order does not
    depend on the order of summation.
    """
    tested = chi_square(contingency(df, features, label, bins, accuracy))
    # As many rows as the vector is wide.
    best_first = Window.orderBy(F.desc_nulls_last(F.round("score", 9)), "feature")
    return tested.withColumn("position", F.row_number().over(best_first))


def variance_ratio(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(feature, rows, f, position): ANOVA F of every feature against the label, best first.

    Counts, means and variances per (feature, label) from one aggregate; the ratio of the variance
    between labels to the one within them follows from these. Infinite where values differ between
    labels only, null without two labels or where all values are equal. Ties by feature number.
    """
    values = feature_values(df.filter(as_column(label).isNotNull()), features, label)
    # A constant is told by its bounds: merged moments of equal values carry rounding errors.
    same, low = F.min("value") == F.max("value"), F.min("value")
    groups = values.filter(F.col("value").isNotNull()).groupBy("feature", "label").agg(
        F.count("*").cast("double").alias("n"), F.when(same, low).otherwise(F.avg("value")).alias("mean"),
        F.when(same, 0.0).otherwise(F.var_pop("value")).alias("variance"))
    per = Window.partitionBy("feature")
    total = groups.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(per) / F.sum("n").over(per))
    sums = total.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2.0))).alias("between"),
        F.sum(F.col("n") * F.col("variance")).alias("within"),
    )
    between = F.col("between") / (F.col("groups") - 1)
    within = F.col("within") / (F.col("rows") - F.col("groups"))
    f = F.when((F.col("groups") > 1) & (F.col("rows") > F.col("groups")),
               F.when(within > 0, between / within)
               .when(between > 0, F.lit(float("inf"))))
    found = sums.select("feature", F.col("rows").cast("long").alias("rows"), f.alias("f"))
    best_first = Window.orderBy(F.desc_nulls_last("f"), "feature")  # as many rows as features
    return found.withColumn("position", F.row_number().over(best_first))


def rank_features(df: DataFrame, features: str = "features", label: str = "label", test: str = "f",
                  bins: int = 10) -> Ranking:
    """The features by ANOVA F-test (``test="f"``) or by chi-squared test over quantile bins
    (``"chi2"``); the driver gets one number per feature."""
    if test not in ("f", "chi2"):
        raise ValueError("test must be 'f' or 'chi2'")
    tested = (variance_ratio(df, features, label) if test == "f"
              else chi_square_ranking(df, features, label, bins))
    rows = tested.select("feature", "position").collect()
    return Ranking(tuple(r["feature"] for r in sorted(rows, key=lambda r: r["position"])))
