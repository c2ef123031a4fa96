"""Importance concentration: normalised gate importance and its entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalars import gate_entropy_term, sigmoid
from flowloom.operators.scores import BIN
from flowloom.scale import small_side

# Node names that count as fields although the catalog does not list them.
ABSTRACT_NODES = ("root", "eth", "ip", "tcp", "tls", "tcp.options", "tls.handshake", "tls.record")


def _log_norm(df: DataFrame, z: Column, by: Sequence[str]) -> DataFrame:
    """(by, log_norm): ln of the sum of exp(z), from partial sums scaled per magnitude bin."""
    parts = (
        df.select(*by, z.cast("double").alias("_z"))
        .withColumn("_bin", F.floor(F.col("_z") / BIN))
        .groupBy(*by, "_bin")
        .agg(F.sum(F.exp(F.col("_z") - (F.col("_bin") + 1) * BIN)).alias("_s"))
    )
    logs = F.collect_list(F.log("_s") + (F.col("_bin") + 1) * BIN)
    merged = parts.groupBy(*by).agg(logs.alias("_l"))
    top = F.array_max("_l")
    total = F.aggregate("_l", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return merged.select(*by, (top + F.log(total)).alias("log_norm"))


def ngi(df: DataFrame, tau: float = 0.2, by: Sequence[str] = (), score: str = "importance_score") -> DataFrame:
    """Add `ngi` = softmax(score / tau), over all rows or per `by`."""
    z = F.col(score) / F.lit(float(tau))
    norms = _log_norm(df, z, by)
    if not by:
        return df.withColumn("ngi", F.exp(z - norms.scalar()))
    return df.join(small_side(norms), list(by)).withColumn("ngi", F.exp(z - F.col("log_norm"))).drop("log_norm")


def gcs(df: DataFrame, by: Sequence[str] = (), value: str = "ngi", eps: float = 1e-12) -> DataFrame:
    """(by, num_fields, gcs, log_n, log_n_over_gcs): entropy of `ngi` and how concentrated it is."""
    p = F.col(value)
    summed = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_fields"), (-F.sum(p * F.log(p + F.lit(eps)))).alias("gcs")
    )
    log_n = F.log(F.col("num_fields").cast("double"))
    return summed.withColumn("log_n", log_n).withColumn(
        "log_n_over_gcs", F.when(F.col("gcs") > 0, F.col("log_n") / F.col("gcs"))
    )


def gcs_per_expert(df: DataFrame, tau: float = 0.2, by: str = "expert_name") -> DataFrame:
    return gcs(ngi(df, tau, [by]), [by]).orderBy(F.desc_nulls_last("log_n_over_gcs"), by)


def valid_fields(df: DataFrame, catalog: Sequence[str], feature: str = "feature_name") -> DataFrame:
    """Rows whose feature is a catalog field or one of the abstract nodes (two bounded lists)."""
    return df.filter(F.col(feature).isin([*ABSTRACT_NODES, *catalog]))


def ngi_valid_fields(df: DataFrame, catalog: Sequence[str], tau: float = 0.2, by: str = "expert_name") -> DataFrame:
    """`ngi` per expert on valid fields; an expert without any is left out."""
    return ngi(valid_fields(df, catalog), tau, [by])


def expected_gate(df: DataFrame, expert: str = "expert_name", weight: str = "weight") -> DataFrame:
    """(expert_name, importance_score): mean weight of each expert over all packets."""
    return df.groupBy(F.col(expert).alias("expert_name")).agg(F.avg(weight).alias("importance_score"))


def gate_report(df: DataFrame, logit: str = "gate_logit") -> DataFrame:
    """(expert_name, feature_name, importance_score): sigmoid of the gate logits, descending inside an expert."""
    scored = df.select("expert_name", "feature_name", sigmoid(F.col(logit)).alias("importance_score"))
    return scored.orderBy("expert_name", F.desc("importance_score"), "feature_name")


def gate_entropy(df: DataFrame, expert: str = "expert_name", gate: str = "gate") -> DataFrame:
    """One row: the mean entropy of each expert's gates, averaged over the experts."""
    per_expert = df.groupBy(expert).agg(F.avg(gate_entropy_term(F.col(gate))).alias("_e"))
    return per_expert.agg(F.avg("_e").alias("gate_entropy"))
