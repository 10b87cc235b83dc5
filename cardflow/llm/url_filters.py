"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path``.  In a pattern ``*`` stands for anything, ``^``
for a separator or the end, a leading ``||`` for the start of the host or of one of its
labels; all else is literal.  A literal token is a run of ``[a-z0-9]`` that the
pattern bounds on both sides, so that a matching URL has it as a whole token.
Each rule is filed under the token that the fewest URLs have.  The tokens of a URL
fetch its candidate rules; only these run their regular expression.  Rules without a
token are candidates of every URL.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.text import ascii_lower, let, unused
from cardflow.operators.skew import join_unique

# So many compiled rules travel in the plan to every task, like a broadcast of this bound; more are a
# table that URL tokens are joined with.  The verdicts are the same.
LITERAL_RULES = 20_000
# Parts of the rules without a token, which every URL has to meet.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    """``rank`` settles which of several matching rules decides: the highest, then the
    longer name, then the greater name."""

    name: str
    pattern: str
    action: str
    rank: int = 0


def host_path_rule(name: str, action: str) -> Rule:
    """``host/path`` fits the host, its subdomains, and paths that start with the path."""
    return Rule(name, "||" + name, action, rank=1)


# Default patterns of unwanted hosts (fixed values).
UNWANTED = (
    Rule("casino", "||casino-", "block"),
    Rule("bets", "||free-bets.", "block"),
    Rule("tracker", "||ads-track.", "block"),
    Rule("spam", "||spam-farm.", "block"),
    Rule("pills", "||cheap-pills.", "block"),
    Rule("adult", "||adult-", "block"),
)


def to_regex(pattern: str) -> str:
    """Java regular expression of a pattern; letter case counts as in the URL."""
    out, body = "(?s)", pattern
    if body.startswith("||"):
        out, body = out + r"^(?:[^/]*\.)?", body[2:]
    for c in body:
        if c == "*":
            out += ".*"
        elif c == "^":
            out += r"(?:[^A-Za-z0-9_.%-]|\z)"
        else:
            out += c if c.isalnum() else "\\" + c if c.isascii() else c
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL has as a whole, without repeats."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ("|" if anchored else "*")
        right = body[m.end()] if m.end() < len(body) else "*"
        if left != "*" and right != "*":
            found.append(m.group().lower())
    return list(dict.fromkeys(found))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def subject_of(url: Column) -> Column:
    return F.concat(host_of(url), path_of(url))


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(ascii_lower(subject), "[^a-z0-9]+"), ""))


def token_counts(urls: DataFrame, tokens: Column, wanted: Sequence[str]) -> dict[str, int]:
    """In how many URLs each wanted token occurs; at most one row per wanted token."""
    if not wanted:
        return {}
    listed = F.from_json(F.lit(json.dumps(list(wanted))), "array<string>")
    found = urls.select(F.explode(F.array_intersect(tokens, listed)).alias("t")).groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


def rarest_tokens(rules: Sequence[Rule], counts: dict[str, int]) -> list[str | None]:
    """The index token of each rule: fewest URLs, then alphabetical; None without one."""
    keys = [literal_tokens(r.pattern) for r in rules]
    return [min(k, key=lambda t: (counts.get(t, 0), t)) if k else None for k in keys]


def _literally(urls: DataFrame, url: str, rules: Sequence[Rule]) -> Column:
    """The best rule of a URL (struct of rank, size, name and action, or null), by an index in the plan."""
    subject = subject_of(F.col(url))
    wanted = sorted({t for r in rules for t in literal_tokens(r.pattern)})
    counts = token_counts(urls.select(url), url_tokens(subject), wanted)
    chosen = rarest_tokens(rules, counts)

    buckets: list[list[dict]] = [[] for _ in range(max(1, 2 * len(rules)))]
    by_token: dict[str, list[int]] = {}
    for i, token in enumerate(chosen):
        if token is not None:
            by_token.setdefault(token, []).append(i)
    for token, ids in by_token.items():
        buckets[zlib.crc32(token.encode()) % len(buckets)].append({"t": token, "r": ids})
    index = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t:string,r:array<int>>>>")
    always = F.from_json(F.lit(json.dumps([i for i, t in enumerate(chosen) if t is None])), "array<int>")
    table = F.from_json(
        F.lit(json.dumps([{"regex": to_regex(r.pattern), "rank": r.rank, "size": len(r.name),
                           "name": r.name, "action": r.action} for r in rules])),
        "array<struct<regex:string,rank:int,size:int,name:string,action:string>>",
    )

    def fetched(token: Column) -> Column:
        bucket = F.get(index, F.pmod(F.crc32(token), F.lit(len(buckets))).cast("int"))
        return F.flatten(F.transform(F.filter(bucket, lambda e: e["t"] == token), lambda e: e["r"]))

    def decided(subject: Column) -> Column:
        candidates = F.concat(always, F.flatten(F.transform(url_tokens(subject), fetched)))
        hits = F.filter(candidates, lambda r: F.rlike(subject, F.get(table, r)["regex"]))
        return F.array_max(F.transform(hits, lambda r: let(F.get(table, r), lambda x: F.struct(
            x["rank"].alias("rank"), x["size"].alias("size"), x["name"].alias("name"), x["action"].alias("action")))))

    return let(subject, decided)


def _by_join(pages: DataFrame, url: str, rules: Sequence[Rule], subject: str, best: str) -> DataFrame:
    """``pages`` with columns ``subject`` and ``best`` as of ``_literally``, for any number of rules.

    Tokens of the distinct subjects are counted and joined with the rules filed under them.  Rules without
    a token are filed under every salt, so that no task meets all subjects for them.
    """
    spark = pages.sparkSession
    known = pages.withColumn(subject, subject_of(F.col(url)))
    each = known.select(F.col(subject).alias("subject")).distinct()
    tokens = each.select("subject", F.explode(url_tokens(F.col("subject"))).alias("token"))

    listed = spark.createDataFrame(
        [(i, to_regex(r.pattern), r.rank, len(r.name), r.name, r.action, literal_tokens(r.pattern)) for i, r in enumerate(rules)],
        "id int, regex string, rank int, size int, name string, action string, tokens array<string>")
    own = listed.select("id", F.explode("tokens").alias("token"))
    used = own.select("token").distinct()
    seen = tokens.join(used, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = own.join(seen, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    index = listed.drop("tokens").join(filed, "id", "left")
    by_token = index.filter("rarest IS NOT NULL").withColumn("token", F.col("rarest.token")).drop("rarest", "id")
    always = index.filter("rarest IS NULL").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("rarest", "id")

    salted = each.withColumn("salt", F.pmod(F.xxhash64("subject"), F.lit(SALTS)).cast("int"))
    candidates = tokens.join(by_token, "token").drop("token").unionByName(salted.join(always, "salt").drop("salt"))
    hits = candidates.filter(F.rlike(F.col("subject"), F.col("regex"))).groupBy("subject").agg(
        F.max(F.struct("rank", "size", "name", "action")).alias(best))
    return join_unique(known, hits.withColumnRenamed("subject", subject), subject, "left")


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule (name of the deciding rule or null), rank and verdict.

    Null URLs and URLs without ``://`` have an empty host and path and match only rules
    that fit an empty subject.  All rows and columns of ``pages`` are kept; columns of these
    names are replaced.  An empty table gives an empty result.
    """
    subject, best = unused(pages, "_subject", "_best")
    if len(rules) <= LITERAL_RULES:
        found = pages.withColumn(best, _literally(pages, url, rules))
    else:
        found = _by_join(pages, url, rules, subject, best)
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "rank", "verdict")]
    judged = found.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(best).alias(best))
    return judged.select(
        *kept, "host", "path", F.col(f"{best}.name").alias("rule"), F.col(f"{best}.rank").alias("rank"),
        F.coalesce(f"{best}.action", F.lit(default)).alias("verdict"),
    )
