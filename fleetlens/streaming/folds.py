"""State machines of the keyed streaming operators.

A fold sees the rows of one key in order and keeps a small JSON-serialisable state.  ``step`` returns the new state
and output rows; ``deadline`` names the event time at which ``expire`` must run even if the key stays silent.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import Any

from fleetlens.operators.first_record import (
    BATCH_CAP,
    BATCH_WINDOW_MS,
    BURST_ALLOWANCE,
    DISTINCT_CAP,
    SAMPLE_BUDGET_BYTES,
    SAMPLE_SUBJECT_BYTES,
    SAMPLE_SUBJECTS,
    SUPPRESSION_WINDOW_MS,
)
from fleetlens.operators.telemetry import (
    ANTI_FLAP_MS,
    ANTI_FLAP_PENALTY,
    BENCH_MS,
    BENCH_THRESHOLD,
    PEER_TIMEOUT_MS,
    next_leader,
)
from fleetlens.vocab import STATES, TERMINAL_STATES

State = dict[str, Any]
Rows = list[tuple]


class Fold:
    """Base: no timer."""

    schema: str
    order: list[str]

    def step(self, state: State, row: Any) -> Rows:
        raise NotImplementedError

    def deadline(self, state: State) -> int | None:
        return None

    def expire(self, state: State, now_ms: int) -> Rows:
        return []

    def over(self, state: State) -> bool:
        """Whether nothing is left to remember."""
        return False


@dataclass
class ReplayFold(Fold):
    schema = "arrival long, seq long, accepted boolean"
    order = ["arrival"]

    def step(self, state, row):
        last = state.get("last")
        accepted = last is None or row.seq > last
        if accepted:
            state["last"] = int(row.seq)
        return [(int(row.arrival), int(row.seq), bool(accepted))]


@dataclass
class MembershipFold(Fold):
    timeout_ms: int = PEER_TIMEOUT_MS
    schema = "kind string, at_ms long"
    order = ["at_ms", "seq"]

    def step(self, state, row):
        at, last, out = int(row.at_ms), state.get("last"), []
        if last is not None and at - last >= self.timeout_ms:
            out.append(("evicted", last + self.timeout_ms))
            last = None
        out.append(("added" if last is None else "updated", at))
        state["last"] = at
        return out

    def deadline(self, state):
        return None if state.get("last") is None else state["last"] + self.timeout_ms

    def expire(self, state, now_ms):
        at = state["last"] + self.timeout_ms
        state["last"] = None
        return [("evicted", at)]

    def over(self, state):
        return state.get("last") is None


@dataclass
class LwwFold(Fold):
    schema = "state string, at_ms long, source string"
    order = ["at_ms", "source"]

    def step(self, state, row):
        rank = STATES.index(row.state) if row.state in STATES else -1
        new = [rank, int(row.at_ms), row.source]
        if state.get("key") is not None and new <= state["key"]:
            return []
        state["key"] = new
        return [(row.state, int(row.at_ms), row.source)]


@dataclass
class AntiFlapFold(Fold):
    window_ms: int = ANTI_FLAP_MS
    penalty: int = ANTI_FLAP_PENALTY
    schema = "tick_ms long, leader string, score long, changed boolean"
    order = ["tick_ms"]

    def step(self, state, row):
        standing = tuple(state.get("standing", (None, None, 0)))
        scores = {row.first_id: int(row.first_score)}
        if isinstance(row.second_id, str):
            scores[row.second_id] = int(row.second_score)
        after, winner, score = next_leader(standing, int(row.tick_ms), scores, self.window_ms, self.penalty)
        state["standing"] = list(after)
        return [(int(row.tick_ms), winner, score, winner != standing[0])]


@dataclass
class PauseFold(Fold):
    max_depth: float = 0.0
    resume_depth: float = 0.0
    schema = "seq long, depth double, latched boolean"
    order = ["at_ms", "seq"]

    def step(self, state, row):
        if row.depth >= self.max_depth:
            state["on"] = True
        elif row.depth <= self.resume_depth:
            state["on"] = False
        return [(int(row.seq), float(row.depth), bool(state.get("on", False)))]


@dataclass
class StateChangeFold(Fold):
    schema = "event_id long, previous string, state string"
    order = ["at_ms", "event_id"]

    def step(self, state, row):
        previous = state.get("state")
        if state.get("over") or previous == row.state:
            return []
        state["state"], state["over"] = row.state, row.state in TERMINAL_STATES
        return [(int(row.event_id), previous, row.state)]


def place(state: State, at_ms: int, width_ms: int) -> int:
    """Rows before this one in its window, which the first row not covered by the window before it opens.

    The batch operators number rows in the same windows; a clock that moves back is not covered either.
    """
    covered = "opened" in state and 0 <= at_ms - state["opened"] < width_ms
    state["opened"], state["rows"] = (state["opened"], state["rows"] + 1) if covered else (at_ms, 1)
    return state["rows"] - 1


@dataclass
class BurstFold(Fold):
    """Rows numbered below ``allowance`` in their window pass; the window's end reports on the others."""

    window_ms: int = SUPPRESSION_WINDOW_MS
    allowance: int = BURST_ALLOWANCE
    schema = (
        "kind string, row_id long, at_ms long, subject string, suppressed_repeats long, distinct_subjects long, "
        "distinct_subjects_capped boolean, sample_subjects array<string>, sample_dropped_for_size int, "
        "appended_before_suppressing long, window_ms long"
    )
    order = ["at_ms", "row_id"]

    def over(self, state):
        return "opened" not in state

    def deadline(self, state):
        return state["opened"] + self.window_ms if "opened" in state else None

    def expire(self, state, now_ms):
        opened, rows, subjects = state.pop("opened"), state.pop("rows"), state.pop("subjects", {})
        if rows <= self.allowance:
            return []
        kept = within_budget([s for s in subjects.values() if s is not None])
        shown = min(SAMPLE_SUBJECTS, len(subjects))
        totals = (rows - self.allowance, min(len(subjects), DISTINCT_CAP), len(subjects) > DISTINCT_CAP)
        return [("summary", None, opened + self.window_ms, None, *totals, kept, shown - len(kept), self.allowance, self.window_ms)]

    def step(self, state, row):
        at = int(row.at_ms)
        over = self.expire(state, at) if "opened" in state and at >= self.deadline(state) else []
        subject = row.subject if isinstance(row.subject, str) else None
        if place(state, at, self.window_ms) < self.allowance:
            return [*over, ("entry", int(row.row_id), at, subject, *[None] * 7)]
        # One subject more than are reported tells that there are more.
        subjects = state.setdefault("subjects", {})
        if subject is not None and len(subjects) <= DISTINCT_CAP:
            mark = hashlib.sha256(subject.encode()).hexdigest()[:32]
            subjects.setdefault(mark, shortened(subject) if len(subjects) < SAMPLE_SUBJECTS else None)
        return over


def shortened(subject: str) -> str:
    """Control characters as dots; a longer text is cut on a character's edge and marked."""
    text = "".join("·" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in subject)
    head = text.encode()[:SAMPLE_SUBJECT_BYTES].decode(errors="ignore")
    return text if head == text else f"{head}…"


def within_budget(samples: list[str]) -> list[str]:
    """Samples that fit into a JSON list of bounded size, each tried in turn."""
    kept, used = [], 2
    for s in samples:
        size = len(json.dumps(s, ensure_ascii=False).encode()) + 1
        if used + size <= SAMPLE_BUDGET_BYTES:
            kept.append(s)
            used += size
    return kept


@dataclass
class RateFold(Fold):
    """In arrival order.  Rows numbered below ``limit`` in their window are admitted; each tells how many were not since
    the last one that was."""

    limit: int = 1
    window_ms: int = 60_000
    schema = "request_id long, at_ms long, admitted boolean, dropped_before long"
    order = ["arrival"]

    def step(self, state, row):
        at = int(row.at_ms)
        admitted = place(state, at, self.window_ms) < self.limit
        gap = state.get("gap", 0)
        state["gap"] = 0 if admitted else gap + 1
        return [(int(row.request_id), at, admitted, gap if admitted else None)]


@dataclass
class CoalesceFold(Fold):
    """``member`` rows assign requests to batches, a ``sent`` row reports each batch when its call goes out."""

    window_ms: int = BATCH_WINDOW_MS
    cap: int = BATCH_CAP
    schema = "kind string, request_id long, batch_start_ms long, batch_no long, batch_size long, sent_by string"
    order = ["at_ms", "request_id"]

    def _send(self, state, why):
        b = state.pop("b", None)
        return [("sent", None, b["start"], b["no"], b["n"], why)] if b else []

    def step(self, state, row):
        at, out = int(row.at_ms), []
        if "b" in state and at - state["b"]["start"] >= self.window_ms:
            out += self._send(state, "window")
        state["seen"] = state.get("seen", 0) + 1
        b = state.setdefault("b", {"start": at, "n": 0, "no": state["seen"]})
        b["n"] += 1
        out.append(("member", int(row.request_id), b["start"], b["no"], None, None))
        if b["n"] >= self.cap:
            out += self._send(state, "full")
        return out

    def deadline(self, state):
        return state["b"]["start"] + self.window_ms if "b" in state else None

    def expire(self, state, now_ms):
        return self._send(state, "window")


@dataclass
class BreakerFold(Fold):
    """A row per bench period, when it ends."""

    threshold: int = BENCH_THRESHOLD
    bench_ms: int = BENCH_MS
    schema = "benched_ms long, until_ms long, failures long"
    order = ["at_ms", "outcome_id"]

    def _end(self, state, until):
        row = (state["trip"], until, state["fails"])
        state.update(fails=0, trip=None, until=None)
        return [row]

    def step(self, state, row):
        at, out = int(row.at_ms), []
        if state.get("until") is not None and (row.ok or at >= state["until"]):
            out = self._end(state, min(at, state["until"]))
        if row.ok:
            state["fails"] = 0
            return out
        state["fails"] = state.get("fails", 0) + 1
        if state["fails"] == self.threshold:
            state["trip"] = at
        if state["fails"] >= self.threshold:
            state["until"] = at + self.bench_ms
        return out

    def over(self, state):
        return not state.get("fails") and state.get("until") is None

    def deadline(self, state):
        return state.get("until")

    def expire(self, state, now_ms):
        return self._end(state, state["until"])
