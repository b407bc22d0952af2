"""Column roles, class names and the fixed tables that describe a flow record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The published data set and its feature extractor define these names.

LABEL_COLUMN_CANDIDATES = ("Label", "label", " Label", "Label ", "class", "Class")
PROTOCOL_COLUMN_CANDIDATES = ("Protocol", "protocol", " Protocol")

IDENTIFIERS = ("Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp")
TRAINING_DROP = ("Flow ID", "Src IP", "Dst IP", "Src Port", "Timestamp")
SCORING_DROP = ("Flow ID", "Src IP", "Dst IP", "Src Port", "Timestamp", "Label")
NEVER_COERCED = ("Label", "Protocol", "Flow ID", "Src IP", "Dst IP", "Timestamp", "Src Port", "Dst Port")

DROP_CLASS = "__DROP__"
BENIGN = "Benign"
INFILTRATION = "Infilteration"
PROTOCOL_CODES = (0, 6, 17)
SUSPICIOUS_CONFIDENCE = 0.25

RAW_LABEL_CLASS = {
    "Benign": "Benign",
    "BENIGN": "Benign",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDoS attacks-LOIC-UDP": "DDoS",
    "DDOS attack-LOIC-UDP": "DDoS",
    "DDOS attack-HOIC": "DDoS",
    "DDoS attacks-HOIC": "DDoS",
    "DoS attacks-Hulk": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS Hulk": "DoS",
    "DoS Slowhttptest": "DoS",
    "DoS slowloris": "DoS",
    "FTP-BruteForce": "Brute Force",
    "FTP-Patator": "Brute Force",
    "SSH-Bruteforce": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Brute Force -Web": "Brute Force",
    "Brute Force -XSS": "Brute Force",
    "Bot": "Botnet",
    "Botnet": "Botnet",
    "Infilteration": "Infilteration",
    "Infiltration": "Infilteration",
    "SQL Injection": "__DROP__",
    "Heartbleed": "__DROP__",
}

# Live extractor field -> training column.
LIVE_FIELD_COLUMN = {
    "src_ip": "Src IP",
    "dst_ip": "Dst IP",
    "src_port": "Src Port",
    "dst_port": "Dst Port",
    "protocol": "Protocol",
    "timestamp": "Timestamp",
    "flow_duration": "Flow Duration",
    "flow_byts_s": "Flow Byts/s",
    "flow_pkts_s": "Flow Pkts/s",
    "fwd_pkts_s": "Fwd Pkts/s",
    "bwd_pkts_s": "Bwd Pkts/s",
    "tot_fwd_pkts": "Tot Fwd Pkts",
    "tot_bwd_pkts": "Tot Bwd Pkts",
    "totlen_fwd_pkts": "TotLen Fwd Pkts",
    "totlen_bwd_pkts": "TotLen Bwd Pkts",
    "fwd_pkt_len_max": "Fwd Pkt Len Max",
    "fwd_pkt_len_min": "Fwd Pkt Len Min",
    "fwd_pkt_len_mean": "Fwd Pkt Len Mean",
    "fwd_pkt_len_std": "Fwd Pkt Len Std",
    "bwd_pkt_len_max": "Bwd Pkt Len Max",
    "bwd_pkt_len_min": "Bwd Pkt Len Min",
    "bwd_pkt_len_mean": "Bwd Pkt Len Mean",
    "bwd_pkt_len_std": "Bwd Pkt Len Std",
    "pkt_len_max": "Pkt Len Max",
    "pkt_len_min": "Pkt Len Min",
    "pkt_len_mean": "Pkt Len Mean",
    "pkt_len_std": "Pkt Len Std",
    "pkt_len_var": "Pkt Len Var",
    "fwd_header_len": "Fwd Header Len",
    "bwd_header_len": "Bwd Header Len",
    "fwd_seg_size_min": "Fwd Seg Size Min",
    "fwd_act_data_pkts": "Fwd Act Data Pkts",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "flow_iat_std": "Flow IAT Std",
    "fwd_iat_tot": "Fwd IAT Tot",
    "fwd_iat_max": "Fwd IAT Max",
    "fwd_iat_min": "Fwd IAT Min",
    "fwd_iat_mean": "Fwd IAT Mean",
    "fwd_iat_std": "Fwd IAT Std",
    "bwd_iat_tot": "Bwd IAT Tot",
    "bwd_iat_max": "Bwd IAT Max",
    "bwd_iat_min": "Bwd IAT Min",
    "bwd_iat_mean": "Bwd IAT Mean",
    "bwd_iat_std": "Bwd IAT Std",
    "fwd_psh_flags": "Fwd PSH Flags",
    "bwd_psh_flags": "Bwd PSH Flags",
    "fwd_urg_flags": "Fwd URG Flags",
    "bwd_urg_flags": "Bwd URG Flags",
    "fin_flag_cnt": "FIN Flag Cnt",
    "syn_flag_cnt": "SYN Flag Cnt",
    "rst_flag_cnt": "RST Flag Cnt",
    "psh_flag_cnt": "PSH Flag Cnt",
    "ack_flag_cnt": "ACK Flag Cnt",
    "urg_flag_cnt": "URG Flag Cnt",
    "ece_flag_cnt": "ECE Flag Cnt",
    "cwr_flag_count": "CWE Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "pkt_size_avg": "Pkt Size Avg",
    "fwd_seg_size_avg": "Fwd Seg Size Avg",
    "bwd_seg_size_avg": "Bwd Seg Size Avg",
    "fwd_byts_b_avg": "Fwd Byts/b Avg",
    "fwd_pkts_b_avg": "Fwd Pkts/b Avg",
    "fwd_blk_rate_avg": "Fwd Blk Rate Avg",
    "bwd_byts_b_avg": "Bwd Byts/b Avg",
    "bwd_pkts_b_avg": "Bwd Pkts/b Avg",
    "bwd_blk_rate_avg": "Bwd Blk Rate Avg",
    "subflow_fwd_pkts": "Subflow Fwd Pkts",
    "subflow_fwd_byts": "Subflow Fwd Byts",
    "subflow_bwd_pkts": "Subflow Bwd Pkts",
    "subflow_bwd_byts": "Subflow Bwd Byts",
    "init_fwd_win_byts": "Init Fwd Win Byts",
    "init_bwd_win_byts": "Init Bwd Win Byts",
    "active_max": "Active Max",
    "active_min": "Active Min",
    "active_mean": "Active Mean",
    "active_std": "Active Std",
    "idle_max": "Idle Max",
    "idle_min": "Idle Min",
    "idle_mean": "Idle Mean",
    "idle_std": "Idle Std",
}

# Live fields measured in seconds; the training columns hold microseconds.
SECONDS_FIELDS = (
    "flow_duration",
    "flow_iat_mean", "flow_iat_max", "flow_iat_min", "flow_iat_std",
    "fwd_iat_tot", "fwd_iat_max", "fwd_iat_min", "fwd_iat_mean", "fwd_iat_std",
    "bwd_iat_tot", "bwd_iat_max", "bwd_iat_min", "bwd_iat_mean", "bwd_iat_std",
    "active_max", "active_min", "active_mean", "active_std",
    "idle_max", "idle_min", "idle_mean", "idle_std",
)


@dataclass(frozen=True)
class FlowSchema:
    """Which columns of a table are identifiers, label, protocol, time and row key."""

    label: str = "Label"
    protocol: str | None = "Protocol"
    ts: str = "Timestamp"
    key: tuple[str, ...] = ("Flow ID",)
    identifiers: tuple[str, ...] = IDENTIFIERS
    drop: tuple[str, ...] = TRAINING_DROP

    def features(self, df: DataFrame) -> list[str]:
        """Numeric columns that are neither label, key nor dropped identifiers."""
        out = set(self.drop) | set(self.key) | {self.label, self.ts}
        return [f.name for f in df.schema if f.name not in out and is_numeric(f.dataType)]


@dataclass(frozen=True)
class Variant:
    """Five classes (infiltration rows dropped) or six (kept)."""

    name: str = "default"
    dropped: tuple[str, ...] = (INFILTRATION,)
    classes: tuple[str, ...] = field(default=("Benign", "Botnet", "Brute Force", "DDoS", "DoS"))


FIVE_CLASSES = Variant()
SIX_CLASSES = Variant("all", (), FIVE_CLASSES.classes + (INFILTRATION,))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if f.name not in exclude and is_numeric(f.dataType)]


def floating_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if f.name not in exclude and is_floating(f.dataType)]


def detect_column(columns: list[str], candidates: tuple[str, ...], required: bool = False) -> str | None:
    """First candidate that is present; a missing required column is an error."""
    for name in candidates:
        if name in columns:
            return name
    if required:
        raise ValueError(f"none of {list(candidates)} among the columns {columns}")
    return None


def detect_label_last(columns: list[str]) -> str:
    """Last column whose trimmed lower-case name is 'label', else the last column."""
    named = [c for c in columns if c.strip().lower() == "label"]
    return (named or columns)[-1]


def require_header(columns: list[str]) -> None:
    """Reject a file whose first (at most ten) column names all read as numbers."""

    def number(text: str) -> bool:
        try:
            float(text)
        except ValueError:
            return False
        return True

    if columns and all(number(c) for c in columns[:10]):
        raise ValueError("the file seems to have no header row: its column names are numbers")
