"""Importance reports from a table of field or expert importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowloom.catalog import CATALOG
from flowloom.operators import importance as ops
from flowloom.sources.tables import write_table


def field_reports(scores: DataFrame, tau: float = 0.2, valid_only: bool = False, catalog: Sequence[str] | None = None):
    """(field NGI, expert GCS) per expert, optionally on catalog fields and abstract nodes only."""
    rows = ops.valid_fields(scores, list(catalog or CATALOG)) if valid_only else scores
    field_ngi = ops.ngi(rows, tau, ["expert_name"])
    return field_ngi, ops.gcs(field_ngi, ["expert_name"])


def expert_reports(scores: DataFrame, tau: float = 0.2):
    """(expert NGI, one GCS row) over all experts."""
    expert_ngi = ops.ngi(scores, tau)
    return expert_ngi, ops.gcs(expert_ngi)


def write_reports(scores: DataFrame, out: str, tau: float = 0.2, valid_only: bool = False, force: bool = True) -> None:
    """Both field reports as tables below `out`, with the temperature in their names."""
    field_ngi, expert_gcs = field_reports(scores, tau, valid_only)
    suffix = str(tau).replace(".", "_")
    write_table(field_ngi, f"{out}/field_ngi_tau_{suffix}", force=force)
    write_table(expert_gcs, f"{out}/expert_gcs_tau_{suffix}", force=force)
