"""Robots rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.config import ROBOT_AGENTS


def robots_rules(robots_txt: Column, agents: tuple[str, ...] = ROBOT_AGENTS) -> Column:
    """Disallowed prefixes that hold for ``agents``, in order.

    Only the last of consecutive user-agent lines counts; agents are compared
    case by case; there are no allow lines, wildcards or comments. Null and empty
    texts give no rule.
    """
    lines = F.transform(F.split(robots_txt, "\r\n|[\n\r\u000b\u000c\u0085  \u001c-\u001e]"), lambda x: F.trim(x))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("rules"))

    def step(state: Column, line: Column) -> Column:
        low = F.lower(line)
        value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        agent, rule = low.startswith("user-agent:"), low.startswith("disallow:")
        on = F.when(agent, value.isin(*agents)).otherwise(state["on"])
        rules = F.when(rule & state["on"] & (value != ""), F.concat(state["rules"], F.array(value))).otherwise(state["rules"])
        return F.struct(on.alias("on"), rules.alias("rules"))

    none = F.array().cast("array<string>")
    return F.coalesce(F.aggregate(lines, start, step, lambda s: s["rules"]), none)


def robots_blocked(robots_txt: Column, path: Column) -> Column:
    """Whether ``path``, without query, begins with a disallowed prefix; an empty path begins with none."""
    return F.exists(robots_rules(robots_txt), lambda rule: path.startswith(rule))
