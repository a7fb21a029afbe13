"""Scores, votes, confusion, ranking and threshold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceway import functions as fn
from sluiceway.catalog.registry import query, r6, table
from sluiceway.operators import ensemble, evaluate


@query("""
    select vec_id, round(case when len(embedding) > 3 then 1 - embedding[4]::double else 0.5 end, 6)
               as attack,
           0.5::double as unknown, 0.5::double as too_short
    from embeddings
""")
def attack_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("p")
    )
    return e.select(
        "vec_id", r6(fn.attack_score("p", 3)).alias("attack"),
        fn.attack_score("p", -1).alias("unknown"), fn.attack_score("p", 9999).alias("too_short"),
    )


_VOTE = (
    "(0.4 * abs(embedding[1]::double) + 0.25 * abs(embedding[2]::double)"
    " + 0.35 * abs(embedding[3]::double))"
)


@query(f"""
    select label::double as orig_label, case when label = 0 then 'normal' else 'attack' end
               as attack_category,
           (label <> 0)::int::double as binary_label, ({_VOTE} >= 0.1)::int::double as binary_pred,
           round({_VOTE}, 6) as binary_score, round(abs(embedding[1]::double), 6) as score_rf,
           round(abs(embedding[2]::double), 6) as score_lr,
           round(abs(embedding[3]::double), 6) as p_gbt_attack
    from embeddings
""")
def soft_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("p", F.col("embedding").cast("array<double>"))
    scores = e.select(
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") == 0, "normal").otherwise("attack").alias("attack_category"),
        *[F.abs(F.get("p", F.lit(i))).alias(c)
          for i, c in enumerate(("score_rf", "score_lr", "p_gbt_attack"))],
    )
    out = ensemble.vote_predictions(scores, cut=0.1)
    rounded = ("binary_score", "score_rf", "score_lr", "p_gbt_attack")
    return out.withColumns({c: r6(c) for c in rounded})


@query("""
    select o_orderkey, (o_totalprice >= 250000)::int::double as pred from orders
""")
def threshold_predict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fn.threshold_predict("o_totalprice", 250000).alias("pred"))


def _judged(spark, sf_dir):
    """Quality as prediction of toxicity, sliced by document language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


@query("""
    select t.v::double as label, q.v::double as prediction, count(doc_id) as rows
    from (values (0), (1), (2)) t(v), (values (0), (1), (2)) q(v)
    left join labels on toxic = t.v and quality = q.v group by all
""")
def confusion(spark, sf_dir):
    """Over a fixed list of three classes, one of which never occurs."""
    df = table(spark, sf_dir, "labels")
    return evaluate.confusion_matrix(df, "quality", "toxic", (0.0, 1.0, 2.0))


_CELLS = """
    c as (select {keys} count(*) as rows, count_if(quality = toxic) as correct,
        count_if(toxic = 0 and quality = 0) as c00, count_if(toxic = 0 and quality = 1) as c01,
        count_if(toxic = 1 and quality = 0) as c10, count_if(toxic = 1 and quality = 1) as c11
        from labels join documents using (doc_id) group by all),
    p as (select *, coalesce(c00 / nullif(c00 + c10, 0), 0) as p0,
        coalesce(c00 / nullif(c00 + c01, 0), 0) as r0, coalesce(c11 / nullif(c11 + c01, 0), 0) as p1,
        coalesce(c11 / nullif(c11 + c10, 0), 0) as r1 from c),
    m as (select *, case when p0 + r0 > 0 then 2 * p0 * r0 / (p0 + r0) else 0 end as f0,
        case when p1 + r1 > 0 then 2 * p1 * r1 / (p1 + r1) else 0 end as f1 from p)
"""


@query(f"""
    with {_CELLS.format(keys="")}
    select 0.0::double as class, (c00 + c01)::bigint as support, round(p0, 6) as precision,
           round(r0, 6) as recall, round(f0, 6) as f1 from m
    union all select 1.0, (c10 + c11)::bigint, round(p1, 6), round(r1, 6), round(f1, 6) from m
""")
def class_metrics(spark, sf_dir):
    out = evaluate.class_metrics(_judged(spark, sf_dir), "quality", "toxic")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(f"""
    with {_CELLS.format(keys="lang,")}
    select lang, rows, round(correct / rows, 6) as accuracy,
           round((p0 + p1) / 2, 6) as macro_precision, round((r0 + r1) / 2, 6) as macro_recall,
           round((f0 + f1) / 2, 6) as macro_f1,
           round((p0 * (c00 + c01) + p1 * (c10 + c11)) / rows, 6) as weighted_precision,
           round((r0 * (c00 + c01) + r1 * (c10 + c11)) / rows, 6) as weighted_recall,
           round((f0 * (c00 + c01) + f1 * (c10 + c11)) / rows, 6) as weighted_f1
    from m
""")
def averaged_metrics(spark, sf_dir):
    out = evaluate.averaged_metrics(_judged(spark, sf_dir), "quality", "toxic", keys=["lang"])
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("lang", "rows")})


_SLICE = """
    round(correct / rows, 6) as accuracy, round(p0, 6) as precision0, round(r0, 6) as recall0,
    round(f0, 6) as f10, round(p1, 6) as precision1, round(r1, 6) as recall1, round(f1, 6) as f11,
    round((f0 + f1) / 2, 6) as "macroF1", c00::double as cm00, c01::double as cm01,
    c10::double as cm10, c11::double as cm11
"""


@query(f"""
    with {_CELLS.format(keys="lang, source,")}, s as (select lang, source, rows, {_SLICE} from m),
    g as (select * from (with {_CELLS.format(keys="lang,")}
          select lang, 'ALL' as source, rows, {_SLICE} from m))
    select * from s union all select * from g
""")
def metrics_by_slice(spark, sf_dir):
    out = evaluate.metrics_by(
        _judged(spark, sf_dir), "quality", "toxic", ["lang", "source"], total_over="source"
    )
    exact = ("lang", "source", "rows", "cm00", "cm01", "cm10", "cm11")
    return out.withColumns({c: r6(c) for c in out.columns if c not in exact})


@query(f"""
    with {_CELLS.format(keys="")}
    select 'run-1' as run_id, 'none' as holdout, 'all' as split, 'ALL' as src_ds, rows, {_SLICE},
           true as stamped from m
""")
def metrics_row(spark, sf_dir):
    """One record of the whole slice; of its time, only that there is one."""
    df = _judged(spark, sf_dir)
    out = evaluate.metrics_row(df, "quality", "toxic", "run-1", "none", "all", "ALL")
    tags = ("run_id", "holdout", "split", "src_ds", "rows", "cm00", "cm01", "cm10", "cm11")
    out = out.withColumn("stamped", F.col("saved_at").isNotNull()).drop("saved_at")
    return out.withColumns({c: r6(c) for c in out.columns if c not in (*tags, "stamped")})


def _priced(spark, sf_dir):
    """Share of the largest order as score, fulfilled orders as positives."""
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_totalprice")).scalar()
    return o.select(
        (F.col("o_totalprice") / top).alias("score"),
        (F.col("o_orderstatus") == "F").cast("double").alias("label"), "o_orderpriority",
    )


_PRICED = """
    x as (select o_totalprice / (select max(o_totalprice) from orders) as score,
              (o_orderstatus = 'F')::int as label, o_orderpriority from orders)
"""


@query(f"""
    with {_PRICED},
    g as (select score, sum(label) as p, sum(1 - label) as n from x group by 1),
    w as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding
              and 1 preceding), 0) as below,
              sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp
          from g),
    a as (select *, tp / (tp + fp) as here, coalesce((tp - p) / nullif(tp - p + fp - n, 0),
              tp / (tp + fp)) as above from w)
    select sum(p)::bigint as positives, sum(n)::bigint as negatives,
           round(sum(p::double * (below + n / 2)) / (sum(p)::double * sum(n)), 6) as roc_auc,
           round(sum(p * (here + above) / 2) / sum(p), 6) as pr_auc
    from a
""")
def ranking(spark, sf_dir):
    out = evaluate.ranking_metrics(_priced(spark, sf_dir), "score", "label")
    return out.withColumns({c: r6(c) for c in ("roc_auc", "pr_auc")})


_SWEEP = f"""
    with {_PRICED},
    s as (select {{keys}} i / 100.0::double as threshold,
              count_if(score >= i / 100.0::double and label = 1) as tp,
              count_if(score >= i / 100.0::double and label = 0) as fp,
              count_if(score < i / 100.0::double and label = 1) as fn
          from x, range(1, 100) r(i) group by all),
    p as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
              coalesce(tp / nullif(tp + fn, 0), 0) as recall from s),
    f as (select *, case when precision + recall > 0
              then 2 * precision * recall / (precision + recall) else 0 end as f1 from p)
"""


@query(_SWEEP.format(keys="") + """
    select threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(precision, 6) as precision, round(recall, 6) as recall,
           round(f1, 6) as f1 from f
""")
def threshold_sweep(spark, sf_dir):
    out = evaluate.threshold_sweep(_priced(spark, sf_dir), "score", "label")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query(_SWEEP.format(keys="o_orderpriority,") + """
    , b as (select *, row_number() over (partition by o_orderpriority
                order by f1 desc, threshold) as place from f)
    select o_orderpriority, threshold, round(f1, 6) as f1, round(precision, 6) as precision,
           round(recall, 6) as recall from b where place = 1
""")
def best_threshold(spark, sf_dir):
    out = evaluate.best_threshold(_priced(spark, sf_dir), "score", "label", ["o_orderpriority"])
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})
