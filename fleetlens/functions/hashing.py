"""Content hashes.  SHA-256 over JSON object text, never over a concatenation of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.jsonfn import object_text


def entry_hash(
    node: Column, seq: Column, at: Column, action: Column, subject: Column, detail: Column, actor: Column, prev: Column
) -> Column:
    """Hash of one audit entry; a null field and an empty one hash differently."""
    fields = {
        "node": node,
        "seq": seq,
        "at": at,
        "action": action,
        "subject": subject,
        "detail": detail,
        "actor": actor,
        "prev": prev,
    }
    return F.sha2(object_text(fields), 256)


def step_hash(capability: Column, resolved_input: Column) -> Column:
    """Hash of a plan step: capability plus its input as key-sorted JSON."""
    return F.sha2(object_text({"capability": capability, "input": resolved_input}), 256)


def fingerprint(columns: dict[str, Column]) -> Column:
    """Identity of a request: every output-determining field, nothing else."""
    return F.sha2(object_text(columns), 256)
