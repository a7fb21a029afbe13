"""Readers, writers and the preparation jobs, over data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway import sources
from sluiceway.catalog.registry import query, r6, table
from sluiceway.catalog.rows import parquet_flows
from sluiceway.operators import clean
from sluiceway.plans import prepare_connections, prepare_csv_flows, prepare_flows
from sluiceway.specs import (
    CONNECTION_COLUMNS,
    CONNECTION_NUMERIC,
    FLOW_COLUMNS,
    FLOW_SAMPLE_FRACTIONS,
)


def _connection_text(spark, sf_dir) -> DataFrame:
    """Events as 43-column connection text: gaps, negative bytes and odd labels included."""
    names = {"view": "Normal.", "click": "satan", "error": "Neptune.", "purchase": "ftp_write",
             "signup": "mystery"}
    label = F.lit(None)
    for event, attack in names.items():
        label = F.when(F.col("event_type") == event, attack).otherwise(label)
    made = {
        "duration": F.when(F.col("user_id") == 0, "x").otherwise(F.col("user_id").cast("string")),
        "protocol_type": F.when(F.col("event_type") == "view", "udp").otherwise("tcp"),
        "service": F.col("event_type"),
        "flag": F.when(F.col("value") > 50, "SF").otherwise("S0"),
        "src_bytes": F.col("value").cast("string"),
        "dst_bytes": (F.col("user_id") - 5).cast("string"),
        "hot": F.when(F.col("event_type") != "click", F.col("user_id").cast("string")),
        "label": label,
        "difficulty": F.col("event_id").cast("string"),
    }
    zero = F.lit("0")
    return table(spark, sf_dir, "events").select(
        *[made.get(c, zero).alias(c) for c in CONNECTION_COLUMNS]
    )


_CONNECTIONS = """
    x as (select event_id::varchar as difficulty, user_id::double as duration, value as src_bytes,
              (user_id - 5)::double as dst_bytes,
              case event_type when 'click' then 0 else user_id end::double as hot,
              case event_type when 'view' then 'normal' when 'click' then 'satan'
                  when 'error' then 'neptune' when 'purchase' then 'ftp_write' else 'mystery' end
                  as label_raw,
              (event_type <> 'view')::int::double as label_binary,
              case event_type when 'view' then 'normal' when 'click' then 'probe'
                  when 'error' then 'dos' when 'purchase' then 'r2l' else 'unknown' end
                  as attack_category
          from events where user_id >= 5 and value >= 0)
"""


@query(f"with {_CONNECTIONS} select * from x")
def positional_csv(spark, sf_dir):
    """Written as headerless text, read back by position, cleaned."""
    path = sources.shared_dir(spark, "connections")
    _connection_text(spark, sf_dir).write.csv(path)
    raw = sources.read_positional_csv(spark, path, CONNECTION_COLUMNS)
    return clean.clean_connections(raw).select(
        "difficulty", "duration", "src_bytes", "dst_bytes", "hot", "label_raw", "label_binary",
        "attack_category",
    )


@query(f"""
    with {_CONNECTIONS}, t as (select label_binary as label, attack_category, count(*) as rows
                               from x group by all)
    select *, 'train' as part from t union all select *, 'test' from t
""")
def prepare_connections_job(spark, sf_dir):
    path = sources.shared_dir(spark, "connections")
    _connection_text(spark, sf_dir).write.csv(path)
    out = sources.shared_dir(spark, "connections-out")
    return prepare_connections(spark, path, path, out)["distribution"]


@query(f"""
    with {_CONNECTIONS}, d as (
      select stddev_samp(duration) as duration, stddev_samp(src_bytes) as src_bytes,
             stddev_samp((label_raw <> 'normal')::int) as tcp from x
    ), s as (select label_raw, stddev_samp(y) as service
             from (select b.label_raw, (a.label_raw = b.label_raw)::int as y
                   from x a, (select distinct label_raw from x) b) group by 1),
    parts(part) as (values ('train'), ('test'))
    select part, x.label_raw, count(*) as rows, round(avg(x.duration) / any_value(d.duration), 6) as duration,
           round(avg(x.src_bytes) / any_value(d.src_bytes), 6) as src_bytes,
           round(avg((x.label_raw <> 'normal')::int) / any_value(d.tcp), 6) as tcp,
           case part when 'train' then round(1 / any_value(s.service), 6) else 0 end as service
    from x join s using (label_raw), d, parts group by part, x.label_raw
""")
def prepare_connections_features(spark, sf_dir):
    """Scaled feature values of both parts; the test file has services that the training file lacks."""
    text = _connection_text(spark, sf_dir)
    train, test = (sources.shared_dir(spark, f"connections-{n}") for n in ("train", "test"))
    text.write.csv(train)
    text.withColumn("service", F.concat(F.lit("new_"), "service")).write.csv(test)
    got = prepare_connections(spark, train, test, sources.shared_dir(spark, "connections-out"))
    width, services = len(CONNECTION_NUMERIC), 5
    protocols = width + 2 + 2  # two protocols, a slot for unseen values at either stage
    f = F.col("f")

    def mean(c):
        return r6(F.avg(c))

    def values(part):
        rows = got[part].select("label_raw", vector_to_array("features").alias("f"))
        known = F.aggregate(F.slice(f, protocols + 1, services), F.lit(0.0), lambda a, b: a + b)
        return rows.groupBy(F.lit(part).alias("part"), "label_raw").agg(
            F.count("*").alias("rows"), mean(f[0]).alias("duration"),
            mean(f[CONNECTION_NUMERIC.index("src_bytes")]).alias("src_bytes"),
            mean(f[width]).alias("tcp"), mean(known).alias("service"))

    return values("train").union(values("test"))


def _write_csv_layouts(spark, sf_dir, broken: bool = False) -> str:
    """Order lines in two header layouts: other column order, one column missing, odd names.

    ``broken`` adds files of the first layout in which every line has a field too many.
    """
    root = sources.shared_dir(spark, "csv-layouts")
    li = table(spark, sf_dir, "lineitem")
    cols = {
        " Flow ID": F.col("l_orderkey").cast("string"),
        "Flow Duration": F.format_number("l_extendedprice", 2),
        "Total Fwd Packets": F.col("l_quantity").cast("string"),
        "Rate": F.when(F.col("l_discount") == 0, "Infinity").otherwise(
            F.col("l_discount").cast("string")),
        "LABEL ": F.when(F.col("l_returnflag") == "A", "BENIGN").when(
            F.col("l_linestatus") == "O", "DoS"),
    }
    a = li.filter(F.col("l_linenumber") <= 3).select(*[c.alias(n) for n, c in cols.items()])
    b = li.filter(F.col("l_linenumber") > 3).select(
        *[c.alias(n) for n, c in reversed(cols.items()) if n != "Rate"])
    for name, df in (("a", a), ("b", b)):
        df.write.csv(f"{root}/{name}", header=True)
    if broken:
        more = {"Rate": F.concat(F.lit("1,"), F.col("l_tax").cast("string"))}
        c = li.filter(F.col("l_quantity") > 45).select(*[more.get(n, c).alias(n) for n, c in cols.items()
                                                         if n != "Flow Duration"], F.lit("5").alias("Flow Duration"))
        c.write.csv(f"{root}/c", header=True, quote="\u0000")
    return f"{root}/*/*.csv"


_CSV_UNION = """
    l as (select distinct l_orderkey, l_extendedprice as "Flow Duration",
              l_quantity as "Total Fwd Packets",
              case when l_linenumber <= 3 then l_discount end as rate0,
              case when l_returnflag = 'A' then 'BENIGN' when l_linestatus = 'O' then 'DoS' end
                  as "Label"
          from lineitem),
    x as (select "Flow Duration", "Total Fwd Packets", nullif(rate0, 0) as "Rate", "Label" from l)
"""


@query(f"""with {_CSV_UNION} select * from x where "Label" is not null""")
def csv_union(spark, sf_dir):
    """Files with drifting headers, united, de-duplicated, stripped of identifiers, parsed."""
    raw = sources.read_csv_union(spark, _write_csv_layouts(spark, sf_dir))
    return clean.clean_flow_csv(raw)


@query(f"""
    with {_CSV_UNION}
    select (select count(*) from lineitem) as lines, 0::bigint as malformed_lines,
           (select count(*) from lineitem) as raw_rows, count(*) as dedup_rows,
           count("Label") as labelled_rows from x
""")
def prepare_csv_flows_job(spark, sf_dir):
    out = sources.shared_dir(spark, "csv-out")
    return prepare_csv_flows(spark, _write_csv_layouts(spark, sf_dir), out, impute="mean")["audit"]


@query(f"""
    with {_CSV_UNION}, n as (select count(*) as good, count_if(l_quantity > 45)::bigint as bad from lineitem)
    select good + bad as lines, bad as malformed_lines, good as raw_rows,
           (select count(*) from x) as dedup_rows, (select count("Label") from x) as labelled_rows from n
""")
def prepare_csv_flows_malformed(spark, sf_dir):
    """The audit of files with planted broken lines, which are counted and left out."""
    out = sources.shared_dir(spark, "csv-out")
    path = _write_csv_layouts(spark, sf_dir, broken=True)
    return prepare_csv_flows(spark, path, out, impute="mean")["audit"]


@query(f"""
    with {_CSV_UNION}, y as (select * from x where "Label" is not null),
    d as (select stddev_samp("Flow Duration") as a, stddev_samp("Total Fwd Packets") as b,
                 avg("Rate") as fill from y),
    r as (select stddev_samp(coalesce("Rate", fill)) as c from y, d)
    select "Label", count(*) as rows, round(avg("Flow Duration") / any_value(a), 6) as duration,
           round(avg("Total Fwd Packets") / any_value(b), 6) as packets,
           round(avg(coalesce("Rate", fill)) / any_value(c), 6) as rate
    from y, d, r group by 1
""")
def prepare_csv_flows_features(spark, sf_dir):
    """Imputed and scaled feature values, all statistics from all rows."""
    out = sources.shared_dir(spark, "csv-out")
    got = prepare_csv_flows(spark, _write_csv_layouts(spark, sf_dir), out, impute="mean", fit_on="all")
    names = got["stages"].stages[0].getInputCols()
    f = vector_to_array("features")
    picked = {"duration": "Flow Duration", "packets": "Total Fwd Packets", "rate": "Rate"}
    return got["flows"].groupBy("Label").agg(F.count("*").alias("rows"), *[
        r6(F.avg(f[names.index(c)])).alias(n) for n, c in picked.items()])


@query("""
    select case when l_linestatus = 'O' then 0 else 1 end::double as label, true as within
    from lineitem where l_tax <> 0 group by 1
""")
def prepare_flows_sampled(spark, sf_dir):
    """The default class-wise sample: normal rows whole, attacks within five deviations of their share."""
    raw = sources.write_table(parquet_flows(spark, sf_dir), sources.shared_dir(spark, "raw-flows"))
    out = sources.shared_dir(spark, "flows-out")
    sizes = prepare_flows(spark, raw, out, spread=True)["distribution"]
    label = F.when(F.col("attack") == 0, 0.0).otherwise(1.0).alias("label")
    whole = spark.read.parquet(raw).filter(~F.isnan("mean")).groupBy(label).agg(F.count("*").alias("all"))
    share = F.create_map(*[F.lit(x) for p in FLOW_SAMPLE_FRACTIONS.items() for x in p])[F.col("label")]
    spread = 5 * F.sqrt(F.col("all") * share * (1 - share))
    n = F.coalesce("rows", F.lit(0))
    return whole.join(sizes, "label", "left").select(
        "label", (F.abs(n - F.col("all") * share) <= spread + 1e-6).alias("within"))


@query("""
    select case when l_linestatus = 'O' then 0 else 1 end::double as label, count(*) as rows
    from lineitem where l_tax <> 0 group by 1
""")
def prepare_flows_job(spark, sf_dir):
    """All classes kept whole, so that the row counts can be checked."""
    raw = sources.write_table(parquet_flows(spark, sf_dir), sources.shared_dir(spark, "raw-flows"))
    out = sources.shared_dir(spark, "flows-out")
    keep_all = {0.0: 1.0, 1.0: 1.0}
    return prepare_flows(spark, raw, out, fractions=keep_all, spread=True)["distribution"]


@query("select case when l_linestatus = 'O' then 0 end as attack, l_quantity as dur from lineitem")
def read_available(spark, sf_dir):
    """A flow table with only two of the wanted columns, and one nobody asked for."""
    flows = table(spark, sf_dir, "lineitem").select(
        F.col("l_tax").alias("extra"), F.col("l_quantity").alias("dur"),
        F.when(F.col("l_linestatus") == "O", 0).alias("attack"),
    )
    path = sources.write_table(flows, sources.shared_dir(spark, "available"))
    return sources.read_available(spark, path, FLOW_COLUMNS, required=("attack",))


@query("select o_orderkey, o_totalprice from orders")
def read_columns(spark, sf_dir):
    path = f"{sf_dir}/orders.parquet"
    return sources.read_parquet_cols(spark, path, ["o_orderkey", "o_totalprice"])


def uflow(spark, sf_dir) -> DataFrame:
    """Line items in the role of common flow records (the inputs' own formulas are not public)."""
    li = table(spark, sf_dir, "lineitem")
    src = F.when(F.col("l_returnflag") == "A", "nsl").when(F.col("l_returnflag") == "N", "cic")
    return li.select(
        F.col("l_quantity").alias("duration_s"), F.col("l_extendedprice").alias("src_bytes"),
        F.col("l_partkey").alias("dst_bytes"),
        (F.col("l_extendedprice") + F.col("l_partkey")).alias("total_bytes"),
        F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.col("l_tax") / F.col("l_discount"))
        .alias("bytes_ratio"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("bytes_per_sec"),
        F.log1p("l_quantity").alias("log_duration"), F.log1p("l_extendedprice").alias("log_src_bytes"),
        (F.col("l_linenumber") < 3).cast("int").alias("proto_tcp"),
        F.when(F.col("l_linenumber") > 3, 1).alias("proto_udp"),
        (F.col("l_linenumber") == 3).cast("string").alias("proto_icmp"),
        ((F.col("l_quantity") > 30) | (F.col("l_discount") > 0.08)).cast("int").alias("label"),
        src.alias("kind"),
    )


@query("""
    select l_quantity as duration_s, l_extendedprice as src_bytes, l_partkey::double as dst_bytes,
           l_extendedprice + l_partkey as total_bytes,
           case when l_discount = 0 then 0 else l_tax / l_discount end as bytes_ratio,
           l_extendedprice / l_quantity as bytes_per_sec, round(ln(1 + l_quantity), 6) as log_duration,
           round(ln(1 + l_extendedprice), 6) as log_src_bytes,
           (l_linenumber < 3)::int::double as proto_tcp, (l_linenumber > 3)::int::double as proto_udp,
           0.0::double as proto_icmp,
           (l_quantity > 30 or l_discount > 0.08::double)::int::double as label, 'pool' as src_ds
    from lineitem
""")
def read_uflow(spark, sf_dir):
    path = sources.write_table(uflow(spark, sf_dir).drop("kind"),
                               sources.shared_dir(spark, "uflow"))
    out = sources.read_uflow(spark, path, "pool")
    return out.withColumns({c: r6(c) for c in ("log_duration", "log_src_bytes")})


@query("select event_id, event_type, value from events")
def write_and_read(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return spark.read.parquet(sources.write_table(df, sources.shared_dir(spark, "written")))


@query("select o_orderkey, o_totalprice, 'F' as holdout, 'r1' as run_id from orders")
def write_run(spark, sf_dir):
    """Keys in the path come back as partition columns."""
    root = sources.shared_dir(spark, "runs")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sources.write_run(o, root, run_id="r1", holdout="F")
    return spark.read.parquet(root)


@query("""
    select o_orderkey, o_totalprice * case o_orderstatus when 'F' then 2 else 1 end as total,
           o_orderstatus as holdout, 'r1' as run_id from orders
""")
def rerun_partitions(spark, sf_dir):
    """A second run of one key replaces its own partition only."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("holdout"),
        F.lit("r1").alias("run_id"))
    path = sources.write_partitions(o, sources.shared_dir(spark, "reruns"), ["run_id", "holdout"])
    again = o.filter("holdout = 'F'").withColumn("total", F.col("total") * 2)
    return spark.read.parquet(sources.write_partitions(again, path, ["run_id", "holdout"]))


@query("select event_type, count(*) as rows, true as stamped from events group by 1")
def stamp(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("rows"))
    out = sources.stamp(counts)
    return out.select("event_type", "rows", F.col("saved_at").isNotNull().alias("stamped"))


@query("""
    select l_orderkey, l_extendedprice as "A", l_quantity as "A__dup2", l_tax as "B" from lineitem
""")
def normalize_headers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").alias("A"), F.col("l_quantity").alias(" A"),
        F.col("l_tax").alias("B "),
    )
    return sources.normalize_headers(li)

