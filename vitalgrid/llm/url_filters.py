"""URL filters: pattern rules found through their rarest literal token.

A rule is ``host/path-prefix`` with an action. It fits its host and every
subdomain when the URL's path starts with the rule's path; the longest rule
that fits wins. Every rule is filed under one of its literal tokens, the one
seen least often in the URLs to be judged. A URL's own tokens fetch the few
candidate rules, and only those run their regular expression.

Everything is DataFrame expressions; the result has one row per input row.
Null URLs and URLs without ``://`` have an empty host and path, so no rule
fits and the default verdict holds. Repeated rows are judged alike. Columns of
the input that clash with the added ones are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import ascii_lower

#: Up to so many rules go into the plan as one literal map; beyond that they are joined.
INLINE_RULES = 1000

_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``text`` is host plus path prefix, such as ``example.net/en/``."""

    text: str
    action: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]

    def regex(self) -> str:
        """Java pattern over host followed by path."""
        quoted = "\\Q" + (self.host + self.path).replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return "\\A(?:[^/]*\\.)?" + quoted + ("" if self.path else "(?:/|\\z)")

    def tokens(self) -> list[str]:
        """Literal tokens that stand whole in every URL that the rule fits."""
        low = self.text.translate({c: c + 32 for c in range(65, 91)})
        parts = re.split(_SPLIT, low)
        if self.path and re.search(r"[a-z0-9]\Z", low):
            parts = parts[:-1]  # the URL's token may be longer
        return sorted({p for p in parts if p})


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = rest
    for mark in "/?#":
        host = F.substring_index(host, mark, 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return ascii_lower(host), path


def url_tokens(address: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(address), _SPLIT), lambda t: t != ""))


def rarest_tokens(addresses: DataFrame, rules: list[UrlRule]) -> dict[UrlRule, str | None]:
    """For each rule its literal token that the fewest addresses hold (ties: the longest, then by text).

    Counts all addresses; at most one row per literal token of the rules comes back.
    """
    wanted = sorted({t for r in rules for t in r.tokens()})
    seen: dict[str, int] = {}
    if wanted:
        held = addresses.select(F.explode(F.array_intersect(url_tokens(F.col("address")), F.array(*map(F.lit, wanted)))).alias("token"))
        seen = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {r: min(r.tokens(), key=lambda t: (seen.get(t, 0), -len(t), t), default=None) for r in rules}


def judge_urls(pages: DataFrame, rules: list[UrlRule], url_col: str = "url", default: str = "allow", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row."""
    if len({r.text for r in rules}) < len(rules):
        raise ValueError("two rules have the same text")
    host, path = url_parts(F.col(url_col))
    added = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    parted = pages.select(*kept, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rank = {r: k for k, r in enumerate(sorted(rules, key=lambda r: (-len(r.text), r.text)))}
    filed = rarest_tokens(parted.select(F.concat("host", "path").alias("address")), rules)
    if not rules:
        best = F.lit(None).cast("struct<rank:int,rule:string,action:string>")
        return parted.withColumns({"rule": best["rule"], "verdict": F.lit(default)})
    if len(rules) <= inline_rules:
        return _inline(parted, rank, filed, default)
    return _joined(parted, rank, filed, default)


def _inline(parted: DataFrame, rank: dict, filed: dict, default: str) -> DataFrame:
    entry = lambda r: F.struct(F.lit(rank[r]).alias("rank"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.regex()).alias("regex"))
    under: dict[str | None, list] = {}
    for r, token in filed.items():
        under.setdefault(token, []).append(entry(r))
    always = F.array(*under.pop(None, [])) if None in under else None
    address = F.concat("host", "path")
    found = []
    if under:
        index = F.create_map(*(x for token, e in sorted(under.items()) for x in (F.lit(token), F.array(*e))))
        hits = F.transform(url_tokens(address), lambda t: F.try_element_at(index, t))
        found.append(F.flatten(F.filter(hits, lambda c: c.isNotNull())))
    if always is not None:
        found.append(always)
    fitting = F.filter(F.concat(*found), lambda c: F.rlike(address, c["regex"]))
    best = F.array_min(F.transform(fitting, lambda c: F.struct(c["rank"].alias("rank"), c["rule"].alias("rule"), c["action"].alias("action"))))
    return parted.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.action"), F.lit(default))}).drop("_best")


def _joined(parted: DataFrame, rank: dict, filed: dict, default: str) -> DataFrame:
    """The same over a rule table: distinct addresses meet the rules by token; Spark picks the join by size."""
    spark = parted.sparkSession
    schema = T.StructType([T.StructField(n, t) for n, t in (("token", T.StringType()), ("rank", T.IntegerType()), ("rule", T.StringType()), ("action", T.StringType()), ("regex", T.StringType()))])
    index = spark.createDataFrame([(token or "", rank[r], r.text, r.action, r.regex()) for r, token in filed.items()], schema)
    addresses = parted.select("host", "path").distinct()
    own = url_tokens(F.concat("host", "path"))
    if None in filed.values():  # rules without a token are tried on every address
        own = F.array_append(own, F.lit(""))
    tokens = addresses.withColumn("token", F.explode(own))
    hits = tokens.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.min(F.struct("rank", "rule", "action")).alias("_best"))
    return parted.join(best, ["host", "path"], "left").select(*(parted[f"`{c}`"] for c in parted.columns), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))
