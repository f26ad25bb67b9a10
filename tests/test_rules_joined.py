"""Rules as a table of keys against plain tests of each request with each rule."""

from __future__ import annotations

import random

import pytest

from fleetlens.operators import rules as ru

RULE = "kind string, effect string, rule_no int, cmd string, any_args boolean, subcmds array<string>, pattern string, model string, model_prefix string, server string, tool string"
REQUEST = "request_id string, kind string, from_node string, cmd string, args array<string>, model string, server string, tool string, `key` string, line string"


def hits(q, r):
    _, kind, _, cmd, args, model, server, tool, *_ = q
    _, effect, _, r_cmd, any_args, subs, pattern, r_model, prefix, r_server, r_tool = r
    args = args or []
    if kind != r[0]:
        return False
    if kind == "shell":
        if effect == "deny" and pattern is not None:
            return pattern in " ".join(x for x in [cmd, " ".join(a for a in args if a is not None) if args else None] if x is not None)
        if r_cmd is None or r_cmd != cmd:
            return False
        if effect == "allow" and subs:
            return bool(args) and args[0] in subs
        return bool(any_args) or not args
    if kind == "llm":
        return model is not None and (model.startswith(prefix) if prefix is not None else model == r_model)
    return server is not None and server == r_server and (r_tool is None or r_tool == tool)


def decided(q, rules):
    first = lambda effect: min((r[2] for r in rules if r[1] == effect and hits(q, r)), default=None)
    deny, allow = first("deny"), first("allow")
    if q[1] == "secret":
        return ("allow", "always_allowed", None)
    if deny is not None:
        return ("deny", "deny_rule", deny)
    if allow is not None:
        return ("allow", "allow_rule", allow)
    return ("deny", "empty_section" if q[1] == "llm" and not any(r[0] == "llm" for r in rules) else "no_rule_matched", None)


@pytest.mark.parametrize("seed,block", [(1, 20_000), (2, 2), (3, 5)])
def test_rules_by_keys(spark, seed, block):
    r = random.Random(seed)
    some = lambda *of: r.choice([None, *of])
    rules, requests = [], []
    for no in range(60):
        kind = r.choice(["shell", "shell", "llm", "mcp"])
        row = [kind, r.choice(["deny", "allow"]), no] + [None] * 8
        if kind == "shell":
            row[3:7] = [some("ls", "git", "rm"), some(True, False), r.choice([None, [], ["a"], ["a", "b"]]), some("x y", "git", "é", "" if no == 50 else "zz")]
        elif kind == "llm":
            row[7:9] = [some("m1", "m12", "q"), some("m", "m1", "" if no == 41 else "m12x")]
        else:
            row[9:11] = [some("s1", "s2"), some("t1", "t2")]
        rules.append(tuple(row))
    for k in range(150):
        kind = r.choice(["shell", "llm", "mcp", "secret", "other"])
        args = r.choice([None, [], ["a"], ["b", "x", "y"], [None, "x y"], ["zz"]])
        requests.append((f"r{k // 2}", kind, "n", some("ls", "git", "rm", "é"), args, some("m1", "m12", "m123", "q", "zz"), some("s1", "s2", "s3"), some("t1", "t3"), "k", "l"))
    for kept in (rules, [x for x in rules if x[0] != "llm" and x[6] is None], []):
        df = spark.createDataFrame(requests, REQUEST)
        none = spark.createDataFrame([], "kind string, node string, level string")
        got = ru.evaluate_rules(df, spark.createDataFrame(kept, RULE), none, pattern_block=block).collect()
        want = [(q[0], q[1], *decided(q, kept)) for q in requests]
        key = lambda x: tuple(str(y) for y in x)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
