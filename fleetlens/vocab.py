"""Fixed vocabularies.  All are small constants, compiled into expressions rather than joined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Task states in convergence rank order (rank = position).
STATES = ["submitted", "planned", "dispatched", "claimed", "running", "expired", "cancelled", "failed", "done"]

# States a task never leaves.
TERMINAL_STATES = ["expired", "cancelled", "failed", "done"]

# Legal task transitions.
LEGAL_TRANSITIONS = {
    "submitted": ["planned", "dispatched", "cancelled", "failed"],
    "planned": ["dispatched", "cancelled"],
    "dispatched": ["claimed", "cancelled", "expired"],
    "claimed": ["running", "failed", "expired", "cancelled"],
    "running": ["done", "failed", "cancelled", "expired"],
}

# Audit actions a verifier accepts.
AUDIT_ACTIONS = [
    "task.dispatched",
    "task.cancelled",
    "plan.resumed",
    "shell.allowed",
    "shell.denied",
    "secret.accessed",
    "peer.approved",
    "policy.loaded",
    "cloud.escalated",
    "audit.truncated",
]

# Actions an auditor scans for.
NOTABLE_ACTIONS = ["cloud.escalated", "shell.denied", "secret.accessed"]

# Goal prefixes in match order, with the capability each asks for.
GOAL_ROUTES = [
    ("run:", "shell.exec"),
    ("shell:", "shell.exec"),
    ("search:", "mesh.search"),
    ("fetch:", "http.fetch"),
    ("summarize:", "doc.summarize"),
    ("schedule:", "schedule.cron"),
]

# Step states a progress view treats as settled.
TERMINAL_STEP_STATES = ["done", "failed", "timed_out", "skipped"]

ZERO_HASH = "0" * 64


def state_rank(state: Column) -> Column:
    """Convergence rank of a state; unknown states rank below every known one."""
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state).cast("int") - 1


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL_STATES)


def is_legal(previous: Column, following: Column) -> Column:
    """Whether ``previous -> following`` is a listed transition."""
    pairs = [f"{a}>{b}" for a, following_states in LEGAL_TRANSITIONS.items() for b in following_states]
    return F.concat_ws(">", previous, following).isin(*pairs)
