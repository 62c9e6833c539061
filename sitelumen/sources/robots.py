"""robots.txt as rows: parsing, group choice and longest-match access, over many sites at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---
AI_AGENTS = "GPTBot ChatGPT-User OAI-SearchBot ClaudeBot Claude-User PerplexityBot Google-Extended CCBot Applebot-Extended Bytespider".split()
# --- end of fixed values ---

#: Paths of a site that are matched in one task, and sets of trie nodes that a worker remembers.
PATHS, MOST_STATES = 100_000, 50_000


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(site_id, line, field, value)`` of ``robots(site_id, raw)``; comments and lines without a colon are left out."""
    lines = robots.select("site_id", F.posexplode(F.split(F.coalesce("raw", F.lit("")), r"\r?\n")).alias("line", "text"))
    plain = F.trim(F.regexp_replace("text", "#.*$", ""))
    lines = lines.select("site_id", "line", plain.alias("text")).where(F.contains("text", F.lit(":")))
    field = F.lower(F.trim(F.substring_index("text", ":", 1)))
    return lines.select("site_id", "line", field.alias("field"), F.trim(F.substr("text", F.instr("text", ":") + 1)).alias("value"))


def robots_rules(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``agents(site_id, group_no, agent)`` and ``rules(site_id, group_no, seq, type, path)``.

    User-agent lines in a row share a group as long as it has no rule; a new group starts with the first user-agent line
    after a rule.
    """
    lines = robots_lines(robots).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site_id").orderBy("line")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    numbered = lines.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(order))
    agents = numbered.where(agent).select("site_id", "group_no", F.col("line").alias("seq"), F.col("value").alias("agent"))
    rules = numbered.where(~agent & (F.col("group_no") > 0)).select("site_id", "group_no", F.col("line").alias("seq"), F.col("field").alias("type"), F.col("value").alias("path"))
    return agents, rules


def chosen_group(agents: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(site_id, token, group_no, specific)``: the first group of the agent itself, else the first of ``*``."""
    pairs = agents.join(F.broadcast(tokens), (F.lower("agent") == F.lower("token")) | (F.col("agent") == "*"))
    specific = F.lower("agent") == F.lower("token")
    best = F.min(F.struct((~specific).alias("general"), "group_no"))
    return pairs.groupBy("site_id", "token").agg(best.alias("best")).select("site_id", "token", "best.group_no", (~F.col("best.general")).alias("specific"))


class Patterns:
    """The rule paths of one group as a trie with wildcard states, scanned once for each path.

    ``*`` is any run of characters and a last ``$`` the end; a path matches from its start. The sets of trie nodes that a
    scan can be in are numbered as they are met, so a character costs one look-up whatever the number of rules.
    """

    def __init__(self, rules: list[tuple[str, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.star, self.loops = [-1], [False]
        self.best: list[tuple[int, bool] | None] = [None]
        self.best_at_end: list[tuple[int, bool] | None] = [None]
        for path, allow in rules:
            self._add(path, allow)
        self._forget()

    def _node(self, loops: bool = False) -> int:
        for column, value in ((self.next, {}), (self.star, -1), (self.loops, loops), (self.best, None), (self.best_at_end, None)):
            column.append(value)
        return len(self.next) - 1

    def _add(self, path: str, allow: bool) -> None:
        at, anchored = 0, path.endswith("$")
        for c in path[:-1] if anchored else path:
            if c != "*":
                at = self.next[at].get(c) or self.next[at].setdefault(c, self._node())
                continue
            if self.star[at] < 0:
                self.star[at] = self._node(loops=True)
            at = self.star[at]
        column = self.best_at_end if anchored else self.best
        column[at] = max(column[at] or (0, False), (len(path), allow))

    def _forget(self) -> None:
        self._numbers: dict[frozenset[int], int] = {}
        self._states: list[tuple[frozenset[int], dict[str, int], tuple[int, bool], tuple[int, bool]]] = []
        self._start = self._state({0})

    def _state(self, nodes: set[int]) -> int:
        """The number of a set of nodes, with all that a wildcard of no characters reaches."""
        waiting = list(nodes)
        while waiting:
            star = self.star[waiting.pop()]
            if star >= 0 and star not in nodes:
                nodes.add(star)
                waiting.append(star)
        key = frozenset(nodes)
        if key not in self._numbers:
            none = (-1, True)
            self._numbers[key] = len(self._states)
            self._states.append((key, {}, max((self.best[n] or none for n in key), default=none), max((self.best_at_end[n] or none for n in key), default=none)))
        return self._numbers[key]

    def allowed(self, path: str) -> bool:
        """Whether the longest rule that matches allows the path; allow on a tie, and where none matches."""
        if len(self._states) > MOST_STATES:
            self._forget()
        states, at = self._states, self._start
        best = states[at][2]
        for c in path:
            nodes, known, _, _ = states[at]
            to = known.get(c)
            if to is None:
                after = {self.next[n][c] for n in nodes if c in self.next[n]} | {n for n in nodes if self.loops[n]}
                to = known[c] = self._state(after)
            at = to
            if not states[at][0]:
                return best[1]
            best = max(best, states[at][2])
        return max(best, states[at][3])[1]


def access(rules: DataFrame, groups: DataFrame, paths: DataFrame) -> DataFrame:
    """``(site_id, token, path, allowed)``: the longest matching rule wins, allow on a tie, no match is allowed.

    The rules of a group travel once to each task that has paths of its site, where they become one trie; the paths of a
    large site are dealt out to several. No row stands for a pair of a path and a rule.
    """
    keys = ["site_id", "token"]
    rule = F.struct("path", (F.col("type") == "allow").alias("allow"))
    own = groups.join(rules, ["site_id", "group_no"]).where("path <> ''").groupBy(*keys).agg(F.array_sort(F.collect_list(rule)).alias("rules"))  # as long as one robots.txt at most
    asked = paths.select("site_id", "path").join(groups.select(*keys), "site_id")
    salts = asked.groupBy(*keys).agg(F.ceil(F.count("*") / PATHS).alias("salts"))
    dealt = asked.join(salts, keys).select(*keys, F.pmod(F.xxhash64("path"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "path", F.lit(None).cast("array<struct<path:string,allow:boolean>>").alias("rules"))
    sent = own.join(salts, keys).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("path"), "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, patterns = None, Patterns([])
        for batch in batches:
            keep, said = [], []
            for i, (site, token, kind, path) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4)], strict=True)):
                if kind == 0:
                    last, patterns = (site, token), Patterns([(r["path"], r["allow"]) for r in batch.column(5)[i].as_py()])
                    continue
                if (site, token) != last:  # a group without rules
                    last, patterns = (site, token), Patterns([])
                keep.append(i)
                said.append(path is None or patterns.allowed(path))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1), rows.column(4), pa.array(said, pa.bool_())], ["site_id", "token", "path", "allowed"])

    order = [*keys, "salt", "kind"]
    met = sent.unionByName(dealt).repartition(*keys, "salt").sortWithinPartitions(*order).select(*keys, "salt", "kind", "path", "rules")
    return met.mapInArrow(run, "site_id string, token string, path string, allowed boolean")


def blocked_ai_agents(robots: DataFrame) -> DataFrame:
    """``(site_id, agent)``: AI agents that a group of their own keeps off ``/``."""
    agents, rules = robots_rules(robots)
    spark = robots.sparkSession
    tokens = spark.sql("SELECT explode(array(" + ", ".join(f"'{a}'" for a in AI_AGENTS) + ")) AS token")
    groups = chosen_group(agents, tokens).where("specific")
    root = robots.select("site_id").distinct().withColumn("path", F.lit("/"))
    return access(rules, groups, root).where("NOT allowed").select("site_id", F.col("token").alias("agent"))
