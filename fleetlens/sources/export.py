"""Exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import neutralize_formula


def csv_cells(audit: DataFrame) -> DataFrame:
    """Audit rows as text cells that no spreadsheet will evaluate."""
    cells = {
        "at_utc": F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd HH:mm:ss"),
        "node": F.col("node_id"),
        "seq": F.col("seq").cast("string"),
        "action": F.col("action"),
        "actor": F.col("actor"),
        "subject": F.col("subject"),
        "detail": F.col("detail"),
        "entry_hash": F.col("entry_hash"),
    }
    return audit.select(*[neutralize_formula(F.coalesce(c, F.lit(""))).alias(n) for n, c in cells.items()])


def export_audit_csv(audit: DataFrame, folder: str) -> None:
    """Every field quoted, inner quotes doubled, formula triggers defused."""
    csv_cells(audit).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', quote='"', emptyValue="").csv(folder)


def export_json(df: DataFrame, folder: str) -> None:
    """One JSON object per line, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
