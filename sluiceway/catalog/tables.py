"""Counts, column statistics, fitted cleaning steps, joins, unions, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceway.catalog.registry import query, r6, table
from sluiceway.operators import joins, stats, unions
from sluiceway.operators.clean import clean_flow_stages
from sluiceway.sources import small_table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(select: str, source: str = "lineitem") -> str:
    """One SELECT per numeric column; ``{c}`` stands for its name."""
    return " union all ".join(
        f"select '{c}' as \"column\", {select.format(c=c)} from {source}" for c in NUMERIC
    )


@query("select count(*) as rows from lineitem")
def count_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"))


@query("select event_type, count(*) as rows from events group by 1")
def class_counts(spark, sf_dir):
    return stats.class_counts(table(spark, sf_dir, "events"), ["event_type"])


@query("""
    select l_returnflag, l_linestatus, count(*) as rows from lineitem group by all
    order by l_returnflag, l_linestatus
""")
def class_counts_two_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    return stats.class_counts(li, keys).orderBy(*keys)


@query("""
    with c as (select event_type, count(*) as rows from events group by 1)
    select event_type, rows, round(rows / sum(rows) over (), 6) as share,
           (sum(rows) over ())::bigint as total, count(*) over () as classes,
           max(rows) over () as largest
    from c
""")
def class_profile(spark, sf_dir):
    out = stats.class_profile(table(spark, sf_dir, "events"), "event_type")
    return out.withColumn("share", r6("share"))


@query("""
    select c_nationkey, count(*) as rows from customer group by 1
    order by rows desc, c_nationkey limit 5
""")
def top_classes(spark, sf_dir):
    return stats.top_classes(table(spark, sf_dir, "customer"), ["c_nationkey"], 5)


@query("""
    select count_if(event_type = 'view')::bigint as views,
           count_if(event_type <> 'view')::bigint as others
    from events
""")
def conditional_count(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").agg(
        F.count_if(e == "view").alias("views"), F.count_if(e != "view").alias("others")
    )


@query(_per_column("round(avg({c}), 6) as mean"))
def mean_columns(spark, sf_dir):
    out = stats.column_stats(table(spark, sf_dir, "lineitem"), NUMERIC, stats.mean_stats)
    return out.withColumn("mean", r6("mean"))


@query(_per_column("var_samp({c}) < 1.0 as low, round(stddev_samp({c}), 4) as deviation"))
def low_variance_columns(spark, sf_dir):
    out = stats.column_stats(table(spark, sf_dir, "lineitem"), NUMERIC, stats.variance_stats)
    return out.select(
        "column", (F.col("variance") < 1.0).alias("low"),
        F.round(F.sqrt("variance"), 4).alias("deviation"),
    )


@query("select l_orderkey, l_quantity, l_extendedprice from lineitem")
def drop_low_variance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *NUMERIC)
    return stats.drop_low_variance(li, 0.01)[0]


@query(_per_column("quantile_disc({c}, 0.5) as median"))
def median_exact(spark, sf_dir):
    values = stats.exact_medians(table(spark, sf_dir, "lineitem"), NUMERIC)
    return small_table(spark, values.items(), "column string, median double")


@query()
def median_approximate(spark, sf_dir):
    return stats.column_stats(table(spark, sf_dir, "lineitem"), NUMERIC, stats.median_stats())


@query(" union all ".join(
    f"select '{c}' as \"column\", round(abs(avg({c}) - quantile_disc({c}, 0.5)) / stddev_pop({c}), 6)"
    f" as skew from lineitem" for c in NUMERIC
))
def skew_exact(spark, sf_dir):
    out = stats.skew_table(table(spark, sf_dir, "lineitem"), NUMERIC, exact=True)
    return out.select("column", r6("skew").alias("skew"))


_LOGGED = ", ".join(
    f"case when (select abs(avg({c}) - quantile_disc({c}, 0.5)) / stddev_pop({c}) > 0.01 from lineitem) "
    f"then round(ln(1 + greatest({c}, 0)), 6) else round({c}, 6) end as {c}" for c in NUMERIC)


@query(f"select l_orderkey, {_LOGGED} from lineitem")
def log_skewed_exact(spark, sf_dir):
    """Exact medians decide which columns are logged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *NUMERIC)
    out, _ = stats.log_skewed(li, 0.01, exact=True)
    return out.withColumns({c: r6(c) for c in NUMERIC})


@query(_per_column("count({c}) as rows, true as close"))
def median_approximate_error(spark, sf_dir):
    """The rank of an approximate median is at most rows / accuracy away from the middle."""
    return _rank_errors(table(spark, sf_dir, "lineitem").select(*NUMERIC), accuracy=1000)


@query("""
    select 'value' as "column", count(value) as rows, true as close from events where event_type <> 'error'
""")
def impute_median_error(spark, sf_dir):
    """The fill value of an approximate median imputation lies close to the middle rank."""
    holes = _holes(spark, sf_dir).select("value")
    return _rank_errors(holes, accuracy=500, fills=stats.fit_impute(holes, "median", accuracy=500))


def _rank_errors(df, accuracy, fills=None):
    """Whether a value lies within rows / accuracy (and its own ties) of the middle, per column."""
    if fills is None:
        rows = stats.column_stats(df, df.columns, stats.median_stats(accuracy)).collect()
        fills = {r["column"]: r["median"] for r in rows}
    found = df.agg(*[x for i, (c, v) in enumerate(fills.items()) for x in (
        F.count(c).alias(f"n{i}"), F.count_if(F.col(c) < v).alias(f"lt{i}"),
        F.count_if(F.col(c) <= v).alias(f"le{i}"))]).first()
    out = []
    for i, c in enumerate(fills):
        n, slack = found[f"n{i}"], found[f"n{i}"] / accuracy + 1
        out.append((c, n, found[f"lt{i}"] <= n / 2 + slack and found[f"le{i}"] >= n / 2 - slack))
    return small_table(df.sparkSession, out, "column string, rows long, close boolean")


@query()
def log_skewed(spark, sf_dir):
    """Approximate medians decide which columns are logged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *NUMERIC)
    return stats.log_skewed(li, 0.01)[0]


def _holes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.lit(None).cast("double").alias("empty"),
    )


@query("""
    select event_id, round(case when event_type = 'error' then
        (select avg(value) from events where event_type <> 'error') else value end, 6) as value,
        0.0::double as empty
    from events
""")
def impute_mean(spark, sf_dir):
    df, _ = stats.impute(_holes(spark, sf_dir), "mean")
    return df.withColumn("value", r6("value"))


@query("""
    select event_id, case when event_type = 'error' then
        (select quantile_disc(value, 0.5) from events where event_type <> 'error') else value end
        as value, 0.0::double as empty
    from events
""")
def impute_median_exact(spark, sf_dir):
    return stats.impute(_holes(spark, sf_dir), "median", exact=True)[0]


@query()
def impute_median(spark, sf_dir):
    return stats.impute(_holes(spark, sf_dir), "median")[0]


@query("""
    with l as (select distinct l_returnflag, l_quantity, l_discount from lineitem)
    select 0 as position, 'raw' as stage, count(*) as rows from lineitem
    union all select 1, 'dedup', count(*) from l
    union all select 2, 'leakage_drop', count(*) from l
    union all select 3, 'cast', count(*) from l
    union all select 4, 'label_filter', count(*) from l where l_returnflag <> 'R'
""")
def stage_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("label"),
        F.col("l_quantity").cast("string").alias("quantity"),
        F.col("l_discount").alias("Src Port"),
    )
    return stats.stage_counts(clean_flow_stages(li))


# -- joins ------------------------------------------------------------------

@query("""
    select event_id, event_type,
           case event_type when 'view' then 0.5 when 'error' then 2.5 else 1.0 end::double as weight
    from events
""")
def lookup_default(spark, sf_dir):
    known = small_table(spark, [("view", 0.5), ("error", 2.5)], "event_type string, weight double")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return joins.lookup_default(e, known, "event_type", "weight", 1.0)


@query("""
    select event_id, value / 200 as s1, user_id::double as s2,
           length(event_type)::double as s3 from events
""")
def join_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [
        e.select("event_id", (F.col("value") / 200).alias("s1")),
        e.select("event_id", F.col("user_id").cast("double").alias("s2")),
        e.select("event_id", F.length("event_type").cast("double").alias("s3")),
    ]
    return joins.join_scores(e.select("event_id"), parts, "event_id")


@query("""
    select o_orderkey, o_totalprice from orders
    where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
""")
def recover_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return joins.recover_rows(o, ids, "o_orderkey", keep_key=True)


# -- unions -----------------------------------------------------------------

def _parties(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("src_ds"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("src_ds"), F.col("s_acctbal").alias("balance"),
        F.col("s_suppkey").alias("id"),
    )
    return c, s


_UNION_SQL = """
    select c_custkey as id, c_acctbal as balance, 'customer' as src_ds from customer
    union all select s_suppkey, s_acctbal, 'supplier' from supplier
"""


@query(_UNION_SQL)
def union_by_name(spark, sf_dir):
    c, s = _parties(spark, sf_dir)
    return unions.union_by_name([c.drop("segment"), s])


@query("""
    select c_custkey as id, c_acctbal as balance, 'customer' as src_ds, c_mktsegment as segment
    from customer union all select s_suppkey, s_acctbal, 'supplier', null from supplier
""")
def union_missing(spark, sf_dir):
    return unions.union_by_name(list(_parties(spark, sf_dir)), allow_missing=True)


@query(_UNION_SQL)
def union_all(spark, sf_dir):
    c, s = _parties(spark, sf_dir)
    return unions.union_all([d.select("id", "balance", "src_ds") for d in (c, s)])
