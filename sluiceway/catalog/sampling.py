"""Sampling, splits, folds, resampling and class weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import functions as fn
from sluiceway.catalog.registry import (
    EVENT_CATEGORY_SQL,
    events_by_category,
    query,
    r6,
    table,
)
from sluiceway.operators import sampling, weights
from sluiceway.specs import RESAMPLE_CAP, RESAMPLE_RATIOS, THREE_WAY


def _bucket_sql(key: str, salt: str = "") -> str:
    text = f"{key}::varchar || '{salt}'" if salt else f"{key}::varchar"
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


@query(f"""
    select event_id, case when {_bucket_sql("event_id", THREE_WAY.salt)} % 100 < 70 then 'train'
        when {_bucket_sql("event_id", THREE_WAY.salt)} % 100 < 85 then 'val' else 'test' end as split
    from events
""")
def split_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return sampling.split_hash(e, "event_id", THREE_WAY)


@query(f"select event_id, ({_bucket_sql('event_id', '#fold42')} % 5)::int as fold from events")
def fold_hash(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return sampling.hash_folds(e, "event_id", 5, portable=True)


@query()
def fold_xxhash(spark, sf_dir):
    return sampling.hash_folds(table(spark, sf_dir, "events").select("event_id"), "event_id", 5)


@query("""
    select h.s as holdout, case when o.o_orderstatus = h.s then 'test' else 'train' end as part,
           count(*) as rows, max(o.o_totalprice) as largest
    from orders o, (select distinct o_orderstatus as s from orders) h group by all
""")
def leave_one_out(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    return sampling.held_out_totals(
        o, "o_orderstatus", {"rows": F.count("*"), "largest": F.max("o_totalprice")},
        {"rows": F.sum("rows"), "largest": F.max("largest")},
    )


_PLAN_SQL = f"""
    with e as (select event_id, {EVENT_CATEGORY_SQL} as attack_category from events),
    c as (select attack_category, count(*) as rows, max(count(*)) over () as top from e group by 1),
    t as (select attack_category, rows, top * case attack_category
              {" ".join(f"when '{k}' then {v}::double" for k, v in RESAMPLE_RATIOS.items())} end as target
          from c),
    p as (select *, least(target / rows, {RESAMPLE_CAP}::double) as fraction from t)
"""


@query(_PLAN_SQL + """
    select attack_category, rows, round(target, 6) as target, round(fraction, 6) as fraction from p
""")
def resample_plan(spark, sf_dir):
    plan = sampling.resample_plan(events_by_category(spark, sf_dir), "attack_category")
    return plan.withColumns({"target": r6("target"), "fraction": r6("fraction")})


def _resampled(spark, sf_dir, mode):
    e = events_by_category(spark, sf_dir).select("event_id", "attack_category")
    out = sampling.resample_to_target(
        e, "attack_category", row_key=["event_id"], mode=mode, portable=True
    )
    return out.groupBy("event_id", "attack_category").agg(F.count("*").alias("copies"))


_DRAW = f"{_bucket_sql('event_id', '#42')} / 4294967296.0::double"


@query(_PLAN_SQL + f"""
    select event_id, attack_category,
           (floor(fraction) + ({_DRAW} < fraction - floor(fraction))::int)::bigint as copies
    from e join p using (attack_category)
    where floor(fraction) + ({_DRAW} < fraction - floor(fraction))::int > 0
""")
def resample_whole(spark, sf_dir):
    return _resampled(spark, sf_dir, "whole")


@query(_PLAN_SQL + f"""
    , d as (select event_id, attack_category, fraction, {_DRAW} as u
            from e join p using (attack_category)),
    -- distribution function of a Poisson variable, 0 ... 40
    s as (select attack_category, i, sum(exp(-fraction) * fraction ** i / factorial(i::int))
              over (partition by attack_category order by i) as cdf
          from p, range(0, 25) r(i) where fraction >= 1),
    k as (select event_id, attack_category, count(*) as copies
          from d join s using (attack_category) where u >= cdf group by all)
    select * from k
    union all
    select event_id, attack_category, 1 from d where fraction < 1 and u < fraction
""")
def resample_poisson(spark, sf_dir):
    return _resampled(spark, sf_dir, "poisson")


@query()
def resample_per_class(spark, sf_dir):
    e = events_by_category(spark, sf_dir).select("event_id", "attack_category")
    return sampling.resample_to_target(e, "attack_category", mode="per_class")


@query()
def sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(table(spark, sf_dir, "lineitem"), 0.3)


@query()
def sample_by(spark, sf_dir):
    fractions = {"view": 1.0, "error": 0.25}
    return sampling.sample_by(table(spark, sf_dir, "events"), "event_type", fractions)


@query()
def split_random(spark, sf_dir):
    parts = sampling.split_random(table(spark, sf_dir, "events").select("event_id"), THREE_WAY)
    return reduce(DataFrame.unionByName, [
        df.withColumn("split", F.lit(name)) for name, df in parts.items()
    ])


@query()
def row_ids(spark, sf_dir):
    return sampling.add_row_id(table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("""
    with c as (select event_type, count(*) as rows from events group by 1)
    select event_type, rows, round(sum(rows) over () / (count(*) over () * rows), 6) as weight
    from c
""")
def weights_multiclass(spark, sf_dir):
    out = weights.class_weights(table(spark, sf_dir, "events"), "event_type")
    return out.withColumn("weight", r6("weight"))


@query("""
    with c as (select event_type, count(*) as n from events group by 1),
    w as (select event_type, sum(n) over () / (count(*) over () * n) as weight from c)
    select event_id, event_type, round(weight, 6) as weight from events join w using (event_type)
""")
def weights_per_row(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return weights.with_class_weights(e, "event_type").withColumn("weight", r6("weight"))


@query("""
    with c as (select count_if(toxic = 0) as n0, count_if(toxic = 1) as n1 from labels)
    select doc_id, round(case when toxic = 1 then (n0 + n1) / (2.0 * n1)
           else (n0 + n1) / (2.0 * n0) end::double, 6) as weight from labels, c
""")
def weights_binary(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = weights.with_binary_weights(df, "toxic")
    return out.select("doc_id", r6("weight").alias("weight"))


@query("""
    with c as (select count_if(toxic = 0) as neg, count_if(toxic = 1) as pos from labels)
    select doc_id, round(case when toxic = 1 then neg / pos else 1 end::double, 6) as weight
    from labels, c
""")
def weights_pos(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return weights.with_pos_weight(df, "toxic").select("doc_id", r6("weight").alias("weight"))


@query(f"""
    select event_id, round({_bucket_sql("event_id", "#7")} / 4294967296.0::double, 6) as u from events
""")
def uniform_portable(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", r6(fn.uniform("event_id", seed=7, portable=True)).alias("u"))
