"""Column lists, label groups and model presets. Data only, no logic."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Names, groups and constants below have to equal those of the
# data sets and of the published programs for results to match.
# ---------------------------------------------------------------------------

# Connection records: 43 headerless columns, by position.
CONNECTION_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
    "label", "difficulty",
]
CONNECTION_CATEGORICAL = ["protocol_type", "service", "flag"]
CONNECTION_NUMERIC = [
    c for c in CONNECTION_COLUMNS if c not in (*CONNECTION_CATEGORICAL, "label", "difficulty")
]

NORMAL = "normal"
UNKNOWN = "unknown"

# Attack name -> category.
ATTACK_GROUPS = {
    "dos": ["back", "land", "neptune", "pod", "smurf", "teardrop", "apache2", "udpstorm",
            "processtable", "worm"],
    "probe": ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"],
    "r2l": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient",
            "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack", "httptunnel", "sendmail",
            "named"],
    "u2r": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps"],
}

# CSV flows: identifier columns that would leak the label.
LEAKAGE_COLUMNS = [
    "Flow ID", "Src IP", "Source IP", "Dst IP", "Destination IP", "Src Port", "Source Port",
    "Dst Port", "Destination Port", "Timestamp",
]
CSV_LABEL = "Label"
CSV_BENIGN = "BENIGN"
CSV_TARGET = "is_attack"

# Parquet flows: columns read when present.
FLOW_COLUMNS = [
    "attack", "proto", "state", "dur", "mean", "stddev", "sum", "min", "max", "pkts", "bytes",
    "spkts", "dpkts", "sbytes", "dbytes", "rate", "srate", "drate", "sport", "dport", "flgs",
]
FLOW_MEASURES = ["dur", "mean", "stddev", "sum", "min", "max", "pkts", "bytes", "spkts", "dpkts",
                 "sbytes", "dbytes", "rate", "srate", "drate"]
FLOW_FLAG_MASKS = {"syn": 0x02, "ack": 0x10, "fin": 0x01, "rst": 0x04}
FLOW_LOGGED = ["dur", "pkts", "bytes", "spkts", "dpkts", "sbytes", "dbytes", "rate", "srate",
               "drate", "bytes_per_pkt", "pkts_per_sec", "bytes_per_sec", "rate_sum"]
FLOW_DERIVED = ["bytes_per_pkt", "pkts_per_sec", "bytes_per_sec", "byte_asymmetry",
                "pkt_asymmetry", "rate_diff", "rate_sum"]
FLOW_CATEGORICAL = ["proto_grp", "state", "sport_bucket", "dport_bucket"]
FLOW_SAMPLE_FRACTIONS = {0.0: 1.0, 1.0: 0.0013}
LOG_CEILING = 1e12

# Common flow record.
UFLOW_FEATURES = [
    "duration_s", "src_bytes", "dst_bytes", "total_bytes", "bytes_ratio", "bytes_per_sec",
    "log_duration", "log_src_bytes", "proto_tcp", "proto_udp", "proto_icmp",
]
UFLOW_LABEL = "label"

# Resampling targets relative to the largest class.
RESAMPLE_RATIOS = {"normal": 1.0, "dos": 1.0, "probe": 1.0, "r2l": 0.25, "u2r": 0.15}
RESAMPLE_CAP = 6.0
RESAMPLE_CAP_SMALL = 4.0

# Soft-vote weights.
VOTE_WEIGHTS = {"rf": 0.40, "lr": 0.25, "gbt": 0.35}

# (selected features, L2 strength) pairs of the logistic grid, in search order.
LOGIT_GRID = [(48, 0.001), (64, 0.001), (80, 0.001), (64, 0.003), (48, 0.003), (96, 0.001),
              (64, 0.01), (80, 0.003)]

# Estimator settings (names are pyspark.ml parameter names).
FOREST_PRESETS = {
    "vote": dict(numTrees=80, maxDepth=12, maxBins=16, minInstancesPerNode=10, minInfoGain=0.004,
                 subsamplingRate=0.6, featureSubsetStrategy="sqrt", cacheNodeIds=False,
                 checkpointInterval=10, seed=42),
    "vote_small": dict(numTrees=60, maxDepth=10, maxBins=16, minInstancesPerNode=12,
                       minInfoGain=0.005, subsamplingRate=0.55, featureSubsetStrategy="sqrt",
                       cacheNodeIds=False, checkpointInterval=10, seed=42),
    "bot": dict(numTrees=300, maxDepth=12, maxBins=128, featureSubsetStrategy="sqrt",
                subsamplingRate=0.8, seed=42),
    "cic": dict(numTrees=200, maxDepth=14, minInstancesPerNode=2, featureSubsetStrategy="sqrt",
                seed=42),
    "nsl": dict(numTrees=300, maxDepth=12, featureSubsetStrategy="log2", subsamplingRate=0.8,
                maxBins=128, seed=42),
}
LOGIT_PRESETS = {
    "vote": dict(maxIter=200, regParam=0.02, elasticNetParam=0.0, standardization=True,
                 family="multinomial", tol=1e-6),
    "vote_small": dict(maxIter=150, regParam=0.03, elasticNetParam=0.0, standardization=True,
                       family="multinomial", tol=1e-6),
    "grid": dict(maxIter=150, elasticNetParam=0.0, tol=1e-6),
    "meta": dict(maxIter=200),
}
GBT_PRESETS = {
    "vote": dict(maxIter=80, maxDepth=6, maxBins=16, stepSize=0.08, subsamplingRate=0.7,
                 featureSubsetStrategy="sqrt", checkpointInterval=10, maxMemoryInMB=512, seed=42),
    "vote_small": dict(maxIter=60, maxDepth=5, maxBins=16, stepSize=0.08, subsamplingRate=0.65,
                       featureSubsetStrategy="sqrt", checkpointInterval=10, maxMemoryInMB=384,
                       seed=42),
}
CV_GRID = {"numTrees": [60, 80], "maxDepth": [10, 12]}

# ---------------------------------------------------------------------------
# Settings of our own.
# ---------------------------------------------------------------------------

# For the session of the caller; the library sets nothing itself. Wide projections grow into
# methods that the JVM's compiler refuses (over 8000 bytes of byte code) and then run
# interpreted, several times slower. With this limit Spark splits them up instead.
SESSION_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@dataclass(frozen=True)
class Split:
    """Named fractions of a train / validation / test split; they must sum to 1."""

    parts: dict[str, float] = field(
        default_factory=lambda: {"train": 0.70, "val": 0.15, "test": 0.15}
    )
    seed: int = 42

    def __post_init__(self) -> None:
        if abs(sum(self.parts.values()) - 1.0) > 1e-9:
            raise ValueError(f"split fractions must sum to 1, got {self.parts}")

    @property
    def salt(self) -> str:
        """Appended to a key before it is hashed: ``#split42:train/val/test``.

        Splits with other parts or another seed are independent, so a part can be split again.
        """
        return f"#split{self.seed}:{'/'.join(self.parts)}"


THREE_WAY = Split()
TWO_WAY = Split({"train": 0.80, "test": 0.20})
TRAIN_VAL = Split({"train": 0.85, "val": 0.15})
