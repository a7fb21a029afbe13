"""Facts about random results that hold for every draw: complete, disjoint, subset, within bounds.

A bound of five standard deviations is exceeded by chance less than once in a million draws; the
seeds are fixed besides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceway.catalog import models, sampling
from sluiceway.catalog.registry import query, table
from sluiceway.operators import sampling as ops
from sluiceway.plans import stack, stack_leave_one_source_out, train_vote
from sluiceway.specs import LOGIT_GRID, TRAIN_VAL, TWO_WAY, VOTE_WEIGHTS


@query("select count(*) as rows, count(distinct event_id) as ids, 3::bigint as parts from events")
def split_random_facts(spark, sf_dir):
    """Every row is in exactly one of the three parts."""
    return sampling.split_random(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"),
        F.count_distinct("split").alias("parts"),
    )


@query("select count(*) as rows, count(*) as ids from lineitem")
def row_ids_facts(spark, sf_dir):
    """As many different numbers as rows."""
    return sampling.row_ids(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids")
    )


@query("select count(*) as rows, count(distinct event_id) as ids, 0 as lo, 4 as hi from events")
def fold_xxhash_facts(spark, sf_dir):
    """Every row has one fold of five."""
    return sampling.fold_xxhash(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"),
        F.min("fold").alias("lo"), F.max("fold").alias("hi"),
    )


@query("select 0::bigint as outside, 0::bigint as repeated, true as within from lineitem limit 1")
def sample_fraction_facts(spark, sf_dir):
    """A subset without repeats, of the expected size."""
    key = ["l_orderkey", "l_linenumber"]
    whole = table(spark, sf_dir, "lineitem").groupBy(*key).count()
    drawn = sampling.sample_fraction(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("n"))
    both = whole.join(drawn, key, "full")
    n, all_ = F.sum("n"), F.sum("count")
    return both.agg(
        F.count_if(F.col("count").isNull()).alias("outside"),
        F.count_if(F.col("n") > F.col("count")).alias("repeated"),
        (F.abs(n - 0.3 * all_) <= 5 * F.sqrt(0.21 * all_)).alias("within"),
    )


@query("""
    select event_type, count(*) as rows, true as within from events
    where event_type in ('view', 'error') group by 1
""")
def sample_by_facts(spark, sf_dir):
    """Listed classes only: one whole, one thinned to a quarter."""
    sizes = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"))
    drawn = sampling.sample_by(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    share = F.when(F.col("event_type") == "view", 1.0).otherwise(0.25)
    spread = 5 * F.sqrt(F.col("rows") * share * (1 - share))
    within = F.abs(F.col("n") - F.col("rows") * share) <= spread
    return drawn.join(sizes, "event_type").select("event_type", "rows", within.alias("within"))


@query(sampling._PLAN_SQL + "select attack_category, rows, true as within from p")
def resample_per_class_facts(spark, sf_dir):
    """Every class is near its target."""
    plan = sampling.resample_plan(spark, sf_dir)
    drawn = sampling.resample_per_class(spark, sf_dir).groupBy("attack_category").agg(
        F.count("*").alias("n"))
    want = F.col("rows") * F.col("fraction")
    within = F.abs(F.coalesce("n", F.lit(0)) - want) <= 5 * F.sqrt(want)
    return plan.join(drawn, "attack_category", "left").select(
        "attack_category", "rows", within.alias("within"))


@query("""
    select 0::bigint as outside, 0::bigint as repeated, count(*) as rows from orders
""")
def split_hash_facts(spark, sf_dir):
    """Parts of a part: nothing is lost, and no row is in two."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    first = ops.split_hash(o, "o_orderkey", ops.Split({"a": 0.8, "b": 0.2}), "one")
    second = ops.split_hash(first.filter("one = 'a'"), "o_orderkey",
                            ops.Split({"a": 0.5, "c": 0.5}), "two").drop("one")
    rest = first.filter("one = 'b'").withColumnRenamed("one", "two")
    return second.union(rest).agg(
        F.count_if(~F.col("two").isin("a", "b", "c")).alias("outside"),
        (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"),
        F.count("*").alias("rows"),
    )


_CONFIGS = ", ".join(f"({k}, {reg}::double)" for k, reg in LOGIT_GRID)
_SMALL = dict(numTrees=5, maxDepth=4)


@query(f"""
    select k::int as chisq_k, r as reg_param, true as sound,
           (select count(*) from embeddings
            where {sampling._bucket_sql("vec_id", TWO_WAY.salt)} % 100 >= 80) as test_rows
    from (values {_CONFIGS}) v(k, r)
""")
def logit_grid_facts(spark, sf_dir):
    """Every configuration is tried, with F1, precision and recall that belong together and a threshold
    on the grid; the first best is the winner, and the cells of its confusion hold every test row."""
    got = models._search(spark, sf_dir, maxIter=20)
    trials, found = got["search"].trials, got["search"]
    cells = got["metrics"].select(
        (F.col("cm00") + F.col("cm01") + F.col("cm10") + F.col("cm11")).cast("long").alias("test_rows"))
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("val_f1")
    whole = F.abs(f1 - F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)) < 1e-9
    step = F.col("best_threshold") * 100
    on_grid = (F.abs(step - F.round(step)) < 1e-9) & step.between(1 - 1e-9, 99 + 1e-9)
    best = F.lit(found.f1) >= f1
    sound = (F.col("status") == "ok") & whole & on_grid & best & f1.between(0.0, 1.0)
    return trials.join(F.broadcast(cells)).select(  # one row
        "chisq_k", "reg_param", sound.alias("sound"), "test_rows")


@query(f"""
    select count(*) as rows, 0::bigint as unsound from embeddings
    where {sampling._bucket_sql("vec_id", TRAIN_VAL.salt)} % 100 >= 85
""")
def vote_facts(spark, sf_dir):
    """Every test row has the weighted mean of its three scores, in [0, 1], and the prediction of it."""
    df = ops.split_hash(models._vectors(spark, sf_dir), "vec_id", TRAIN_VAL)
    train, test = (df.filter(F.col("split") == s).drop("split") for s in ("train", "val"))
    small = {"rf": _SMALL, "lr": dict(maxIter=10), "gbt": dict(maxIter=3, maxDepth=3)}
    out = train_vote(train, test, preset="vote_small", row_key=["vec_id"], overrides=small)["predictions"]
    w = VOTE_WEIGHTS
    mean = (w["rf"] * F.col("score_rf") + w["lr"] * F.col("score_lr") + w["gbt"] * F.col("p_gbt_attack")
            ) / sum(w.values())
    sound = (F.abs(F.col("binary_score") - mean) < 1e-9) & F.col("binary_score").between(0.0, 1.0) & (
        F.col("binary_pred") == (F.col("binary_score") >= 0.5).cast("double"))
    return out.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound"))


@query("select count(*) as rows, 0::bigint as unsound, count(*) as evaluated from lineitem")
def stack_facts(spark, sf_dir):
    """Expert scores of every row lie in [0, 1]; the parts of the stack hold every row once.

    The scores are those the stack has written, so the experts run once.
    """
    pool = models._pool(spark, sf_dir)
    experts = models._experts(pool, **_SMALL)
    got = stack(pool, experts, row_key="row_id", maxIter=10)
    sound = F.lit(True)
    for tag in experts:
        sound = sound & F.coalesce(F.col(f"p_{tag}").between(0.0, 1.0), F.lit(False))
    cells = got["metrics"].agg(
        F.sum(F.col("cm00") + F.col("cm01") + F.col("cm10") + F.col("cm11")).cast("long").alias("evaluated"))
    rows = got["stacked"].agg(F.count("*").alias("rows"), F.count_if(~sound).alias("unsound"))
    return rows.join(F.broadcast(cells))  # one row each


@query("""
    with s as (select case l_returnflag when 'A' then 'nsl' when 'N' then 'cic' else 'bot' end as src
               from lineitem), h as (select distinct src as holdout from s),
    r as (select holdout, case when src = holdout then 'holdout_test' else 'oof_train' end as split, src
          from s, h)
    select holdout, split, src as src_ds, count(*) as rows, true as sound from r group by all
    union all select holdout, split, 'ALL', count(*), true from r where split = 'oof_train' group by all
""")
def stack_holdout_facts(spark, sf_dir):
    """Every holdout is evaluated on all sources, each slice with cells that add up to its rows."""
    pool = models._pool(spark, sf_dir)
    out = stack_leave_one_source_out(pool, models._experts(pool, **_SMALL), row_key="row_id", maxIter=10)
    cells = F.col("cm00") + F.col("cm01") + F.col("cm10") + F.col("cm11")
    sound = (cells == F.col("rows")) & F.col("macroF1").between(0.0, 1.0)
    return out.select("holdout", "split", "src_ds", "rows", sound.alias("sound"))


@query("select count(*) as rows, 0::bigint as unsound from embeddings")
def boosted_facts(spark, sf_dir):
    """Every row has one of the two predictions, and the label more often than not."""
    out = models.boosted_trees(spark, sf_dir)
    bad = F.count_if(~F.col("prediction").isin(0.0, 1.0))
    worse = F.when(2 * F.count_if(F.col("prediction") == F.col("label")) <= F.count("*"), 1).otherwise(0)
    return out.agg(F.count("*").alias("rows"), (bad + worse).cast("long").alias("unsound"))


@query("""
    select t::int as num_trees, d::int as max_depth, count(*) >= 0 as sound
    from (values (60), (80)) a(t), (values (10), (12)) b(d), embeddings group by all
""")
def cross_validated_facts(spark, sf_dir):
    """Every setting of the tuning grid has an average F1."""
    return models.cross_validated(spark, sf_dir).select(
        "num_trees", "max_depth", F.col("f1").between(0.0, 1.0).alias("sound"))
