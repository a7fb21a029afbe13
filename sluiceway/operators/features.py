"""Feature layers over whole tables: one projection per layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.flow import (
    asymmetry,
    bucket_port,
    bucket_protocol,
    clipped_log1p,
    diff_sum,
    duration_seconds,
    flag_bits,
    safe_ratio,
)
from sluiceway.functions.labels import binary_label, label_from_flag
from sluiceway.functions.parsing import as_column, coerce_double
from sluiceway.operators.clean import filter_finite
from sluiceway.specs import (
    CSV_BENIGN,
    CSV_LABEL,
    CSV_TARGET,
    FLOW_CATEGORICAL,
    FLOW_DERIVED,
    FLOW_FLAG_MASKS,
    FLOW_LOGGED,
    FLOW_MEASURES,
)


def _if_present(
    df: DataFrame, inputs: list[str], made: dict[str, Column], default: float | None
) -> dict[str, Column]:
    """The made columns when all inputs exist; else the default, or nothing."""
    if all(c in df.columns for c in inputs):
        return made
    return {} if default is None else {name: F.lit(default) for name in made}


def csv_flow_features(df: DataFrame, label: str = CSV_LABEL) -> DataFrame:
    """Duration in seconds, packet rate, bytes per packet and the binary target.

    A feature whose inputs are missing is left out.
    """
    packets = ["Total Fwd Packets", "Total Backward Packets"]
    lengths = ["Total Length of Fwd Packets", "Total Length of Bwd Packets"]
    base = df.withColumns(_if_present(
        df, ["Flow Duration"], {"flow_duration_sec": duration_seconds("Flow Duration")}, None
    ))

    def total(pair: list[str]) -> Column:
        return as_column(pair[0]) + as_column(pair[1])

    rates = _if_present(base, [*packets, "flow_duration_sec"],
                        {"packets_per_sec": safe_ratio(total(packets), "flow_duration_sec")}, None)
    sizes = _if_present(base, [*packets, *lengths],
                        {"bytes_per_packet": safe_ratio(total(lengths), total(packets))}, None)
    return base.withColumns({**rates, **sizes, CSV_TARGET: binary_label(label, CSV_BENIGN)})


def label_flows(df: DataFrame, flag: str = "attack", label: str = "label") -> DataFrame:
    """Replace the integer attack flag by a 0.0 / 1.0 label."""
    return df.withColumn(label, label_from_flag(flag)).drop(flag)


def flow_features(
    df: DataFrame, label: str = "label", finite_check: str = "after"
) -> DataFrame:
    """Bucketed, derived and log-scaled features of parquet flows.

    ``finite_check="after"`` filters the finished columns: a NaN or infinity in a logged
    column has been clipped by then and only drops the row where it reached an unlogged one.
    ``"before"`` drops rows with any non-finite measure first.
    """
    if finite_check not in ("after", "before"):
        raise ValueError("finite_check must be 'after' or 'before'")
    flags = list(FLOW_FLAG_MASKS)
    measures = [c for c in FLOW_MEASURES if c in df.columns]

    typed: dict[str, Column] = {c: coerce_double(c) for c in measures}
    if "proto" in df.columns:
        typed["proto_grp"] = bucket_protocol("proto")
    for side in ("sport", "dport"):
        if side in df.columns:
            typed[f"{side}_bucket"] = bucket_port(side)
    typed.update(
        flag_bits("flgs") if "flgs" in df.columns else {f: F.lit(0.0) for f in flags}
    )
    passed = [c for c in (label, "state") if c in df.columns]
    out = df.select(*passed, *[col.alias(name) for name, col in typed.items()])
    if finite_check == "before":
        out = filter_finite(out, measures)

    rate_diff, rate_sum = diff_sum("srate", "drate")
    out = out.withColumns({
        **_if_present(out, ["bytes", "pkts"], {"bytes_per_pkt": safe_ratio("bytes", "pkts")}, 0.0),
        **_if_present(out, ["dur", "pkts"], {"pkts_per_sec": safe_ratio("pkts", "dur")}, 0.0),
        **_if_present(out, ["dur", "bytes"], {"bytes_per_sec": safe_ratio("bytes", "dur")}, 0.0),
        **_if_present(out, ["sbytes", "dbytes"],
                      {"byte_asymmetry": asymmetry("sbytes", "dbytes")}, 0.0),
        **_if_present(out, ["spkts", "dpkts"], {"pkt_asymmetry": asymmetry("spkts", "dpkts")}, 0.0),
        **_if_present(out, ["srate", "drate"], {"rate_diff": rate_diff, "rate_sum": rate_sum}, 0.0),
    })

    numeric = [*measures, *flags, *FLOW_DERIVED]
    # Flags are 0 or 1 and logged columns lie in [0, log1p(ceiling)], so only the other
    # numbers can be anything but finite; they are final already.
    out = filter_finite(out, [c for c in numeric if c not in (*flags, *FLOW_LOGGED)])
    order = [label, *FLOW_CATEGORICAL, *numeric]
    return out.select(*[
        (clipped_log1p(c) if c in FLOW_LOGGED else as_column(c)).alias(c)
        for c in order if c in out.columns
    ])
