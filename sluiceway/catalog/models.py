"""Feature stages, model fits, searches and ensembles on the given tables, all at their presets."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import sources
from sluiceway.catalog.jobs import uflow
from sluiceway.catalog.registry import events_by_category, query, r6, table
from sluiceway.catalog.sampling import _bucket_sql
from sluiceway.operators import ensemble, sampling, selection, stages, tuning, weights
from sluiceway.plans import (
    stack,
    stack_leave_one_source_out,
    train_expert,
    train_logit_grid,
    train_vote,
)
from sluiceway.plans.expert import expert_stages
from sluiceway.specs import TRAIN_VAL, TWO_WAY

@query("""
    select l_orderkey, l_linenumber,
           round(l_quantity / (select stddev_samp(l_quantity) from lineitem), 6) as q,
           round(l_tax / (select stddev_samp(l_tax) from lineitem), 6) as t
    from lineitem
""")
def scaled_features(spark, sf_dir):
    """Assembled and scaled to unit deviation, without centring."""
    li = table(spark, sf_dir, "lineitem")
    flow = Pipeline(stages=[
        stages.assembler(["l_quantity", "l_tax"], "features_raw", "keep"), stages.scaler(),
    ])
    out = flow.fit(li).transform(li).withColumn("f", vector_to_array("features"))
    return out.select("l_orderkey", "l_linenumber", r6(F.col("f")[0]).alias("q"),
                      r6(F.col("f")[1]).alias("t"))


@query(f"""
    with c as (select event_type, row_number() over (order by count(*) desc, event_type) - 1 as i
               from events group by 1)
    select event_id, i::double as idx,
           i::int as slot, ((select count(*) from c) + 2)::int as width
    from events join c using (event_type)
""")
def indexed_one_hot(spark, sf_dir):
    """Index by frequency, one-hot with a slot for unseen values at either stage.

    The vector is told by its hot slot and its width: the classes of the data and two more.
    """
    e = table(spark, sf_dir, "events")
    flow = Pipeline(stages=[
        stages.indexer("event_type", "idx"),
        OneHotEncoder(inputCols=["idx"], outputCols=["vec"], dropLast=False, handleInvalid="keep"),
    ])
    out = flow.fit(e).transform(e)
    hot = out.select("event_id", "idx", vector_to_array("vec").alias("hot"))
    only = F.size(F.filter("hot", lambda x: x != 0.0)) == 1
    slot = F.when(only, F.array_position("hot", F.lit(1.0)) - 1)
    return hot.select("event_id", "idx", slot.cast("int").alias("slot"), F.size("hot").alias("width"))


@query("""
    select o_orderkey, x, x * x as xx, y, x * y as xy, y * y as yy
    from (select o_orderkey, o_totalprice / 1e6::double as x, o_custkey / 1e3::double as y from orders)
""")
def polynomial_terms(spark, sf_dir):
    """All terms up to degree 2."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1e6).alias("x"), (F.col("o_custkey") / 1e3).alias("y")
    )
    flow = Pipeline(stages=[
        stages.assembler(["x", "y"]),
        PolynomialExpansion(degree=2, inputCol="features", outputCol="poly_features"),
    ])
    out = flow.fit(o).transform(o).select("o_orderkey", vector_to_array("poly_features").alias("p"))
    names = ("x", "xx", "y", "xy", "yy")
    return out.select("o_orderkey", *[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as training table: label 0 is normal, the others fall into four categories."""
    category = F.when(F.col("label") == 0, "normal").when(F.col("label") <= 3, "dos").when(
        F.col("label") <= 6, "probe").when(F.col("label") <= 8, "r2l").otherwise("u2r")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") > 0).cast("double").alias("label"),
        category.alias("attack_category"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


@query("""
    select max(len(embedding))::bigint as width, count(*) as rows from embeddings
""")
def vector_size(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return df.agg(F.count("*").alias("rows")).withColumn(
        "width", F.lit(stages.vector_size(df)).cast("bigint")
    )


@query()
def selected_features(spark, sf_dir):
    """The eight best features by F-test."""
    df = _vectors(spark, sf_dir)
    model = stages.top_features(8).fit(df)
    return model.transform(df).select("vec_id", "label", "sel_features")


_ELEMENTS = """
    e as (select vec_id, (label > 0)::int as y, unnest(embedding)::double as v,
                 unnest(range(len(embedding)))::int as feature from embeddings)
"""


@query(f"""
    with {_ELEMENTS}, g as (
      select feature, y, count(*)::double as n, avg(v) as m, var_pop(v) as s from e group by all
    ), t as (select *, sum(n * m) over f / sum(n) over f as a from g window f as (partition by feature)),
    r as (
      select feature, sum(n)::bigint as rows,
             (sum(n * (m - a) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) as f
      from t group by feature
    )
    select feature, rows, round(f, 6) as f,
           row_number() over (order by f desc, feature) as position from r
""")
def variance_ratio(spark, sf_dir):
    """ANOVA F of every vector element against the label, ranked."""
    out = selection.variance_ratio(_vectors(spark, sf_dir))
    return out.select("feature", "rows", r6("f").alias("f"), F.col("position").cast("long").alias("position"))


_CHI_SQUARE = f"""
    {_ELEMENTS}, ranked as (
      select *, row_number() over (partition by feature order by v) as nth,
             count(*) over (partition by feature) as n from e
    ), cuts as (
      select feature, i, min(v) as cut from ranked, range(1, 10) t(i)
      where nth >= ceil(i / 10::double * n) group by all
    ), binned as (
      select e.vec_id, e.feature, e.y, e.v, count(cut) as bin
      from e left join cuts on cuts.feature = e.feature and e.v > cut group by all
    ), cells as (select feature, bin, y, count(*) as o from binned group by all),
    parts as (
      select feature, o, sum(o) over (partition by feature, bin) as r, bin, y,
             sum(o) over (partition by feature, y) as c from cells
    ), tested as (
      select feature, sum(o)::bigint as rows,
             greatest(sum(o) * (sum(o::double * o / (r::double * c)) - 1), 0) as statistic,
             ((count(distinct bin) - 1) * (count(distinct y) - 1))::int as dof
      from parts group by feature
    ), scored as (
      select *, (cbrt(statistic / dof) - (1 - 2 / (9.0::double * dof))) / sqrt(2 / (9.0::double * dof))
             as score from tested
    ), placed as (
      select *, row_number() over (order by round(score, 9) desc nulls last, feature) as position from scored
    )
"""


@query(f"""
    with {_CHI_SQUARE}
    select feature, rows, round(statistic, 6) as statistic, dof, round(score, 6) as score, position
    from placed
""")
def chi_square_features(spark, sf_dir):
    """Chi-squared test of every real-valued vector element in ten quantile bins, ranked."""
    out = selection.chi_square_ranking(_vectors(spark, sf_dir))
    return out.select("feature", "rows", r6("statistic").alias("statistic"), "dof",
                      r6("score").alias("score"), F.col("position").cast("long").alias("position"))


@query(f"""
    with {_CHI_SQUARE}, best as (
      select feature, row_number() over (order by feature) - 1 as slot from placed where position <= 8
    )
    select vec_id, y::double as label, slot::int as slot, v as value from e join best using (feature)
""")
def chi_square_selected(spark, sf_dir):
    """The eight best features by chi-squared test, as a slice of the vectors."""
    df = _vectors(spark, sf_dir)
    slicer = selection.rank_features(df, test="chi2").slicer(8)
    return slicer.transform(df).select(
        "vec_id", "label", F.posexplode(vector_to_array("sel_features")).alias("slot", "value"))


@query()
def logit_grid_chi_square(spark, sf_dir):
    """The grid over features selected by chi-squared test: metrics of its winner on unseen rows."""
    return _search(spark, sf_dir, select_by="chi2")["metrics"]


def _pool(spark, sf_dir) -> DataFrame:
    """Common flow records of three sources with a frozen row id."""
    raw = uflow(spark, sf_dir).withColumn("src_ds", F.coalesce("kind", F.lit("bot")))
    return sampling.add_row_id(sources.uflow_from(raw, keep=("src_ds",)), spread=True)


def _experts(pool: DataFrame, **override) -> dict:
    """The three experts, each fitted on its own source, at their presets but for the overrides."""
    return {
        tag: expert_stages(tag, **override).fit(pool.filter(F.col("src_ds") == tag))
        for tag in ("nsl", "cic", "bot")
    }


@query()
def rf_expert(spark, sf_dir):
    """Metrics of every part of the split."""
    flows = sources.uflow_from(uflow(spark, sf_dir))
    return train_expert(flows, "bot", spread=True)["metrics"]


@query()
def score_experts(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return ensemble.score_all(pool, _experts(pool), ["row_id", "src_ds", "label"])


@query()
def stack_meta(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    return stack(pool, _experts(pool), row_key="row_id")["metrics"]


@query()
def stack_holdout(spark, sf_dir):
    """Leave-one-source-out: pooled, per source and unseen source."""
    pool = _pool(spark, sf_dir)
    return stack_leave_one_source_out(pool, _experts(pool), row_key="row_id")


@query()
def stack_holdout_refit(spark, sf_dir):
    """Leave-one-source-out on scores of experts refitted without the rows they score.

    Three folds of three experts are nine fits, so these are forests of 20 trees of depth 6.
    """
    pool = _pool(spark, sf_dir)
    small = dict(numTrees=20, maxDepth=6)
    makers = {tag: (lambda tag=tag: expert_stages(tag, **small)) for tag in ("nsl", "cic", "bot")}
    return stack_leave_one_source_out(pool, dict.fromkeys(makers), folds=3, row_key="row_id",
                                      refit=makers)


@query()
def expert_ranking(spark, sf_dir):
    """Areas under ROC and precision-recall curve of an expert on its held-out part."""
    return train_expert(sources.uflow_from(uflow(spark, sf_dir)), "nsl", spread=True)["ranking"]()


@query()
def vote_ensemble(spark, sf_dir):
    df = sampling.split_hash(_vectors(spark, sf_dir), "vec_id", TRAIN_VAL)
    train, test = (df.filter(F.col("split") == s).drop("split") for s in ("train", "val"))
    return train_vote(
        train, test, preset="vote_small", row_key=["vec_id"], spread=True,
    )["predictions"]


@query()
def logit_grid(spark, sf_dir):
    """A row per configuration of the whole grid, with its tuned threshold."""
    return _search(spark, sf_dir)["search"].trials


@query()
def logit_winner(spark, sf_dir):
    """Metrics of the grid's winner on rows that neither the fit nor the threshold has seen."""
    return _search(spark, sf_dir)["metrics"]


def _search(spark, sf_dir, **args) -> dict:
    """The grid search on a held-out split."""
    df = sampling.split_hash(_vectors(spark, sf_dir), "vec_id", TWO_WAY)
    train, test = (df.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    return train_logit_grid(train, test, row_key="vec_id", **args)


@query()
def cross_validated(spark, sf_dir):
    """Average F1 of every setting of the tuning grid, on the sample the search is meant for."""
    df = stages.indexer("attack_category", "category_label").fit(
        _vectors(spark, sf_dir)).transform(_vectors(spark, sf_dir))
    rf = stages.forest("vote_small", "category_label")
    fitted = tuning.cv_tune(df, rf, "category_label", row_key=["vec_id"])
    rows = [
        (pm[rf.numTrees], pm[rf.maxDepth], float(m))
        for pm, m in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics, strict=True)
    ]
    return sources.small_table(spark, rows, "num_trees int, max_depth int, f1 double")


@query()
def boosted_trees(spark, sf_dir):
    """Predictions of a binary boosted model with balanced row weights."""
    df = weights.with_binary_weights(_vectors(spark, sf_dir), "label", name="binWeight")
    model = stages.boosted("vote_small", weight="binWeight").fit(df)
    return model.transform(df).select("vec_id", "label", "prediction")


@query("""
    select name, count(*) as rows, 0::bigint as mismatches
    from embeddings, (values ('boosted'), ('forest'), ('logit')) m(name) group by name
""")
def classifier_round_trip(spark, sf_dir):
    """Saved and loaded classifiers predict every row as the fitted ones do."""
    df = sources.lineage_cut(_vectors(spark, sf_dir), spread=True)
    makers = {
        "forest": stages.forest("vote_small", "label", numTrees=5, maxDepth=5),
        "logit": stages.logit("meta", "label", maxIter=20),
        "boosted": stages.boosted("vote_small", maxIter=5, maxDepth=3),
    }
    out = None
    for name, estimator in makers.items():
        fitted = Pipeline(stages=[estimator]).fit(df)
        loaded = sources.load_model(sources.save_model(fitted, sources.shared_dir(spark, name)))
        made = ("rawPrediction", "probability", "prediction")
        both = fitted.transform(df).withColumns({
            "p": vector_to_array("probability"), "y": F.col("prediction")}).drop(*made)
        both = loaded.transform(both).withColumn("q", vector_to_array("probability"))
        same = (F.col("p") == F.col("q")) & (F.col("y") == F.col("prediction"))
        row = both.agg(F.count("*").alias("rows"), F.count_if(~same).alias("mismatches")).select(
            F.lit(name).alias("name"), "rows", "mismatches")
        out = row if out is None else out.union(row)
    return out


@query(f"""
    select fold, count(*) as rows from (
      select {_bucket_sql("vec_id", "#cv42")} % 2 as fold from embeddings
      where {_bucket_sql("vec_id", "#42")} / 4294967296.0::double < 0.3::double
    ) group by fold
""")
def cv_fold_sizes(spark, sf_dir):
    """The sample and the folds of the tuning grid."""
    folds = tuning.cv_folds(_vectors(spark, sf_dir), ["vec_id"])
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("rows"))


@query("select event_type, count(*) as rows from events group by 1")
def model_round_trip(spark, sf_dir):
    """A saved and loaded indexer gives the classes the same index as the fitted one."""
    e = events_by_category(spark, sf_dir)
    fitted = Pipeline(stages=[stages.indexer("event_type", "idx")]).fit(e)
    loaded = sources.load_model(
        sources.save_model(fitted, sources.shared_dir(spark, "model"))
    )
    both = fitted.transform(e).select("event_id", "event_type", F.col("idx").alias("a")).join(
        loaded.transform(e).select("event_id", F.col("idx").alias("b")), "event_id"
    )
    return both.filter(F.col("a") == F.col("b")).groupBy("event_type").agg(F.count("*").alias("rows"))
