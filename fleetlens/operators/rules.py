"""Rule evaluation over requests, prefix routing, message intake and record checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import jsonfn
from fleetlens.vocab import GOAL_ROUTES

# Patterns of one page: an automaton, held by one task beside the lines it scans.
RULE_PAGE = 20_000

# Several entries for one node: the first of these levels among them holds, then any other by name.
TRUST_PRECEDENCE = ("untrusted", "default", "trusted")


def _strictest(level: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(x) for x in TRUST_PRECEDENCE]), level)
    return F.min_by(level, F.struct(F.when(rank > 0, rank).otherwise(len(TRUST_PRECEDENCE) + 1), level))


def resolve_trust(requests: DataFrame, trust: DataFrame) -> DataFrame:
    """Trust level of each request: an exact node entry beats ``*``, which beats the default.

    Of several entries for the same node or for ``*`` the strictest holds.
    """
    exact = trust.filter(F.col("node") != "*").groupBy("kind", F.col("node").alias("from_node")).agg(_strictest(F.col("level")).alias("own"))
    # One row per request kind at most, hence small enough to broadcast whatever the trust table holds.
    star = trust.filter(F.col("node") == "*").groupBy("kind").agg(_strictest(F.col("level")).alias("any"))
    joined = requests.join(exact, ["kind", "from_node"], "left").join(F.broadcast(star), "kind", "left")
    return joined.withColumn("trust", F.coalesce("own", "any", F.lit("default"))).drop("own", "any")


def _key_of(kind: str, subject: Column, second: Column | None = None) -> Column:
    parts = [F.lit(kind).alias("kind"), subject.alias("key")]
    return F.struct(*parts, *([] if second is None else [second.alias("second")]))


def _least_no(rules: DataFrame, **cases: Column) -> DataFrame:
    """Of rules with a ``match`` key: the least rule number for each key and case."""
    return rules.filter(F.col("match").isNotNull()).groupBy("match").agg(*[F.min(F.when(c, F.col("rule_no"))).alias(n) for n, c in cases.items()])


def _by_subject(rules: DataFrame) -> DataFrame:
    """Rules that name a command, a model or a server alone: (match, deny_any, deny_bare, allow_any, allow_bare).

    ``bare`` rules hold for a command without arguments only.
    """
    c = F.col
    deny, limited = c("effect") == "deny", F.coalesce(F.size("subcmds"), F.lit(0)) > 0
    bare = (c("kind") == "shell") & ~F.coalesce(c("any_args"), F.lit(False))
    match = (
        F.when((c("kind") == "shell") & ~F.when(deny, c("pattern").isNotNull()).otherwise(limited), _key_of("shell", c("cmd")))
        .when((c("kind") == "llm") & c("model_prefix").isNull(), _key_of("llm", c("model")))
        .when((c("kind") == "mcp") & c("tool").isNull(), _key_of("mcp", c("server")))
    )
    return _least_no(rules.withColumn("match", match), deny_any=deny & ~bare, deny_bare=deny & bare, allow_any=~deny & ~bare, allow_bare=~deny & bare)


def _by_pair(rules: DataFrame) -> DataFrame:
    """Rules that name a command and its first argument, or a server and its tool: (match, deny, allow)."""
    c = F.col
    deny, limited = c("effect") == "deny", F.coalesce(F.size("subcmds"), F.lit(0)) > 0
    subs = rules.filter((c("kind") == "shell") & ~deny & limited).select("*", F.explode_outer("subcmds").alias("sub"))
    shell = subs.withColumn("match", _key_of("shell", c("cmd"), c("sub"))).drop("sub")
    mcp = rules.filter((c("kind") == "mcp") & c("tool").isNotNull()).withColumn("match", _key_of("mcp", c("server"), c("tool")))
    return _least_no(shell.unionByName(mcp), deny=deny, allow=~deny)


def _by_prefix(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that name a prefix of models: (key, deny, allow) for each model asked for, which meets them by its own prefixes."""
    named = rules.filter((F.col("kind") == "llm") & F.col("model_prefix").isNotNull())
    by = named.groupBy(F.col("model_prefix").alias("prefix")).agg(
        F.min(F.when(F.col("effect") == "deny", F.col("rule_no"))).alias("deny"), F.min(F.when(F.col("effect") != "deny", F.col("rule_no"))).alias("allow")
    )
    models = requests.filter((F.col("kind") == "llm") & F.col("model").isNotNull()).select(F.col("model").alias("key")).distinct()
    prefixes = models.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("prefix"))
    return prefixes.join(by, "prefix").groupBy("key").agg(F.min("deny").alias("deny"), F.min("allow").alias("allow"))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by block, patterns first: the least rule whose pattern each line holds."""
    import ahocorasick

    at, least, finder = None, {}, None
    for batch in batches:
        if not batch.num_rows:
            continue
        i, j = batch.column("i").to_pylist(), batch.column("j").to_pylist()
        found: list[tuple[str, int]] = []
        for place, line, no in zip(zip(i, j), batch.column("line").to_pylist(), batch.column("rule_no").to_pylist()):
            if place != at:
                at, least, finder = place, {}, None
            if no is not None:
                least[line] = min(no, least.get(line, no))
                continue
            if finder is None and least:
                finder = ahocorasick.Automaton()
                for pattern, number in least.items():
                    finder.add_word(pattern, number)
                finder.make_automaton()
            if finder is not None and (hit := min((number for _, number in finder.iter(line)), default=None)) is not None:
                found.append((line, hit))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["line", "deny"])


def _by_pattern(requests: DataFrame, rules: DataFrame, block: int) -> DataFrame:
    """Rules that deny a part of the command line: (line, deny) for each line that holds one.

    Lines and patterns meet on a grid: a task holds one automaton of about ``block`` patterns and scans its lines once.
    """
    patterns = rules.filter((F.col("kind") == "shell") & (F.col("effect") == "deny") & F.col("pattern").isNotNull()).select("pattern", F.col("rule_no").cast("int").alias("rule_no"))
    across = max(1, -(-patterns.count() // block))
    groups = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lines = requests.filter(F.col("kind") == "shell").select("line").distinct()
    asked = lines.select(dealt("line", groups).alias("i"), each(across).alias("j"), "line", F.lit(None).cast("int").alias("rule_no"))
    # An empty pattern is part of every line, which no automaton finds.
    known = patterns.filter("pattern <> ''").select(each(groups).alias("i"), dealt("pattern", across).alias("j"), F.col("pattern").alias("line"), "rule_no")
    grid = known.unionByName(asked).repartition(groups * across, "i", "j").sortWithinPartitions("i", "j", F.col("rule_no").isNull())
    return grid.mapInArrow(_matched, "line string, deny int").groupBy("line").agg(F.min("deny").alias("deny"))


def evaluate_rules(
    requests: DataFrame, rules: DataFrame, trust: DataFrame, llm_section: bool = True, pattern_block: int | None = None
) -> DataFrame:
    """Decision per request: untrusted sources are denied, then the first deny rule, then the first allow rule, then
    the default.  ``llm_section=False`` means no model rules were written at all, which allows every model.

    ``requests``: request_id, kind (shell|llm|mcp|secret), from_node, cmd, args, model, server, tool.

    Rules are a table that requests meet by equality: of the command, model or server, of that with the first argument
    or the tool, and of prefixes of the model.  Each of these tables has one row a key, so no request is doubled, and
    plans do not grow with the rules.
    """
    c = F.col
    asked = requests.select("request_id", "kind", "from_node", "cmd", F.coalesce("args", F.array().cast("array<string>")).alias("args"), "model", "server", "tool")
    judged = resolve_trust(asked, trust).withColumns(
        {
            "line": F.concat_ws(" ", "cmd", F.when(F.size("args") > 0, F.array_join("args", " "))),
            "match": F.when(c("kind") == "shell", _key_of("shell", c("cmd"))).when(c("kind") == "llm", _key_of("llm", c("model"))).when(c("kind") == "mcp", _key_of("mcp", c("server"))),
            "pair": F.when(c("kind") == "shell", _key_of("shell", c("cmd"), F.try_element_at("args", F.lit(1)))).when(c("kind") == "mcp", _key_of("mcp", c("server"), c("tool"))),
        }
    )
    # A null inside a key is no match, though two such keys are equal.
    whole = lambda key, *names: F.when(reduce(lambda x, y: x & y, [c(f"{key}.{n}").isNotNull() for n in names]), c(key))
    judged = judged.withColumns({"match": whole("match", "key"), "pair": whole("pair", "key", "second")})
    effective = rules.filter(c("effect").isin("deny", "allow"))
    marks = lambda df, tag: df.select(*[c(n).alias(n if n in ("match", "pair", "key", "line") else f"{tag}_{n}") for n in df.columns])
    found = judged.join(marks(_by_subject(effective), "s"), "match", "left")
    found = found.join(marks(_by_pair(effective).withColumnRenamed("match", "pair"), "p"), "pair", "left")
    found = found.join(marks(_by_prefix(judged, effective), "m"), (c("kind") == "llm") & (c("model") == c("key")), "left")
    found = found.join(marks(_by_pattern(judged, effective, pattern_block or RULE_PAGE), "t").withColumnRenamed("line", "held"), (c("kind") == "shell") & (c("line") == c("held")), "left")
    bare = (c("kind") != "shell") | (F.size("args") == 0)
    always = effective.filter((c("kind") == "shell") & (c("effect") == "deny") & (c("pattern") == "")).agg(F.min("rule_no")).scalar()
    judged = found.withColumns(
        {
            "deny_no": F.least("s_deny_any", F.when(bare, c("s_deny_bare")), c("p_deny"), c("m_deny"), c("t_deny"), F.when(c("kind") == "shell", always)),
            "allow_no": F.least("s_allow_any", F.when(bare, c("s_allow_bare")), c("p_allow"), c("m_allow")),
        }
    )
    llm_empty = effective.filter(c("kind") == "llm").isEmpty()
    is_llm = c("kind") == "llm"
    reason = F.when(c("kind") == "secret", "always_allowed")
    if not llm_section:
        reason = reason.when(is_llm, "no_section")
    reason = reason.when(c("trust") == "untrusted", "untrusted_source")
    if llm_section and llm_empty:
        reason = reason.when(is_llm, "empty_section")
    reason = (
        reason.when(c("deny_no").isNotNull(), "deny_rule")
        .when(c("allow_no").isNotNull(), "allow_rule")
        .otherwise("no_rule_matched")
    )
    out = judged.withColumn("reason", reason)
    allowed = c("reason").isin("always_allowed", "no_section", "allow_rule")
    return out.select(
        "request_id",
        "kind",
        F.when(allowed, "allow").otherwise("deny").alias("decision"),
        "reason",
        F.when(c("reason") == "deny_rule", c("deny_no")).when(c("reason") == "allow_rule", c("allow_no")).alias("rule_no"),
    )


def default_routes(spark) -> DataFrame:
    """The built-in routes: route_no, prefix, capability, emits (whether a plan is produced)."""
    rows = [(no, prefix, capability, capability == "shell.exec") for no, (prefix, capability) in enumerate(GOAL_ROUTES)]
    return spark.createDataFrame(rows, "route_no int, prefix string, capability string, emits boolean")


def route_by_prefix(texts: DataFrame, capabilities: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Route goals by their prefix: no_match, matched_but_unsupported or matched, with the trimmed body.

    ``texts``: id, text.  ``routes``: route_no, prefix, capability, emits; the first route that fits holds.  Routes that
    do not emit say no_match where their capability is offered.  Goals meet routes by equality of their first characters.
    """
    routes = default_routes(texts.sparkSession) if routes is None else routes
    offered = capabilities.select("capability", F.lit(True).alias("offered")).distinct()
    table = routes.select("route_no", "prefix", "capability", "emits").join(offered, "capability", "left")
    # As many numbers as there are different lengths of prefixes.
    lengths = sorted(r.n for r in routes.select(F.char_length("prefix").alias("n")).distinct().collect())
    goals = texts.select("id", "text", F.regexp_replace("text", r"^\s+", "").alias("goal"))
    heads = goals.select("goal", F.explode(F.array(*[F.substring("goal", 1, n) for n in lengths])).alias("prefix")) if lengths else None
    if heads is None:
        empty = [F.lit(None).cast("string").alias(c) for c in ("prefix", "capability", "body")]
        return texts.select("id", F.lit("no_match").alias("outcome"), *empty)
    row = F.struct("prefix", "capability", "emits", "offered")
    best = heads.distinct().join(table, "prefix").groupBy("goal").agg(F.min_by(row, F.col("route_no")).alias("r"))
    marked = goals.join(best, "goal", "left").select("id", "goal", "r.*")
    outcome = (
        F.when(F.col("prefix").isNull(), "no_match")
        .when(F.col("offered").isNull(), "matched_but_unsupported")
        .when(F.col("emits"), "matched")
        .otherwise("no_match")
    )
    body = F.regexp_replace(F.col("goal").substr(F.char_length("prefix") + 1, F.char_length("goal")), r"^\s+|\s+$", "")
    shown = outcome != "no_match"
    return marked.select(
        "id",
        outcome.alias("outcome"),
        F.when(shown, F.col("prefix")).alias("prefix"),
        F.when(shown, F.col("capability")).alias("capability"),
        F.when(outcome == "matched", body).alias("body"),
    )


def intake_filter(messages: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Messages from listed senders that are neither opt-out events nor blank.  An empty list admits nobody."""
    live = messages.filter(F.col("opt_out_type").isNull() & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    return live.join(allowlist.select("sender").distinct(), "sender", "left_semi")


def intake_near_misses(messages: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Senders not listed whose number is listed in the other channel's form."""
    listed = allowlist.select("sender").distinct()
    outside = messages.groupBy("sender").agg(F.count("*").alias("messages")).join(listed, "sender", "left_anti")
    bare = F.regexp_replace("sender", "^whatsapp:", "")
    toggled = F.when(F.startswith("sender", F.lit("whatsapp:")), bare).otherwise(F.concat(F.lit("whatsapp:"), F.col("sender")))
    return outside.withColumn("other_form", toggled).join(
        listed.select(F.col("sender").alias("other_form")), "other_form", "left_semi"
    )


def check_records(df: DataFrame, rules: Sequence[dict], column: str = "violations") -> DataFrame:
    """Every violated rule per record.

    A rule is a dict with ``rule`` and ``field``: required; enum (values); min / max (bound); min_length (length);
    no_extra_keys (values), where the field holds a JSON object.
    """

    def broken(rule: dict) -> Column:
        value = F.col(rule["field"])
        match rule["rule"]:
            case "required":
                return value.isNull()
            case "enum":
                return ~value.isin(*rule["values"])
            case "min":
                return value < rule["bound"]
            case "max":
                return value > rule["bound"]
            case "min_length":
                return F.char_length(value) < rule["length"]
            case "no_extra_keys":
                keys = F.json_object_keys(value)
                return F.size(F.array_except(keys, F.array(*[F.lit(v) for v in rule["values"]]))) > 0
            case other:
                raise ValueError(f"unknown rule {other!r}")

    found = [F.when(broken(r), F.lit(f"{r['field']}:{r['rule']}")) for r in rules]
    return df.withColumn(column, F.array_compact(F.array(*found)))


def numeric_field(text: Column, path: str) -> Column:
    """A JSON number within a text payload, for use in rules."""
    return jsonfn.number_at(jsonfn.parse(text), path)
