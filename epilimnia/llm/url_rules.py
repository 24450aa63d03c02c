"""URL filters: host rules, and pattern rules that are found by their rarest literal token.

Pattern rules are written as filter lists write them: ``||`` binds to the host or a subdomain, ``|`` to an end of the URL, ``*``
stands for anything, ``^`` for a separator or the end. A literal token is a run of letters and digits that the pattern bounds on
both sides; of a rule's tokens, the one that the fewest URLs have is its key. The tokens of a URL fetch the rules with these keys,
and only those run their regular expression. Rules without such a token are tried on every URL.

Host rules (host, path, verdict) hold for a host and its subdomains where the URL's path begins with the rule's; the longest rule
wins. They come before pattern rules: a URL without a host rule is blocked if a pattern matches, and else allowed.

Defined results: NULL or no ``://`` gives an empty host and path and is allowed. Only A-Z of the host is lower-cased; patterns see
the whole URL in lower case. Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilimnia.llm.common import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path, verdict (fixed values of the contract).
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Advertising, tracking, spam and adult patterns.
PATTERNS = [
    "/ads/",
    "/ad/*^banner^",
    "||ads.",
    "||track.",
    "||tracker.",
    "/track/*^pixel^",
    "casino-",
    "-casino.",
    "||casino.",
    "||spam.",
    "spam-farm",
    "-farm.example.",
    "||adult.",
    "/porn/",
    "^xxx^",
    "-win.example.",
    "/click?*^aff=",
    "^affiliate=",
    "|ftp://",
    ".exe|",
]

TOKEN = re.compile(r"[a-z0-9]+")


def pattern_regex(pattern: str) -> str:
    """Regular expression, in the common syntax of Java, Python and RE2, for a URL in lower case."""
    body, start, end = pattern.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], "^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    parts = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    return start + "".join(parts.get(c) or (c if c.isalnum() else "\\" + c) for c in body) + end


def literal_tokens(pattern: str) -> list[str]:
    """Runs of letters and digits that any matching URL has as whole tokens."""
    body = pattern.lower()
    head, tail = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    out = []
    for m in TOKEN.finditer(body):
        left = head if m.start() == 0 else body[m.start() - 1] != "*"
        right = tail if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.append(m.group())
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs. The result has at most one number for each token of the rules."""
    wanted = F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, tokens)))
    rows = urls.select(F.explode(wanted).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect() if tokens else []
    return {r["token"]: r["n"] for r in rows}


def index_rules(patterns: list[str], counts: dict[str, int]) -> tuple[dict[str, list[str]], list[str]]:
    """Expressions by their rarest token, and those without one."""
    by_token: dict[str, list[str]] = {}
    rest = []
    for pattern in patterns:
        if tokens := literal_tokens(pattern):
            by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(pattern_regex(pattern))
        else:
            rest.append(pattern_regex(pattern))
    return by_token, rest


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, NULL without one. The rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def matches(url: Column, patterns: list[str], counts: dict[str, int]) -> Column:
    """Whether a pattern matches, by the index of rarest tokens."""
    by_token, rest = index_rules(patterns, counts)

    @F.pandas_udf("boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        always = [re.compile(x, re.S) for x in rest]
        fetched: dict[str, list[re.Pattern]] = {}  # compiled once in a task, when a URL first has the token

        def rules(token: str) -> list[re.Pattern]:
            if token not in fetched:
                fetched[token] = [re.compile(x, re.S) for x in by_token[token]]
            return fetched[token]

        def one(text: str | None) -> bool:
            text = (text or "").lower()
            if any(x.search(text) for x in always):
                return True
            return any(x.search(text) for t in by_token.keys() & TOKEN.findall(text) for x in rules(t))

        for urls in batches:
            yield urls.map(one, na_action=None).astype(bool)

    return found(url)


def judge(pages: DataFrame, host_rules: list[tuple[str, str, str]], patterns: list[str]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row."""
    urls = pages.select("page_id", "url")
    counts = token_counts(urls, sorted({t for p in patterns for t in literal_tokens(p)}))
    cut = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), matches(F.col("url"), patterns, counts).alias("hit"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), host_rules)
    by_pattern = F.when(F.col("hit"), "block").otherwise("allow")
    return cut.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_pattern).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), HOST_RULES, PATTERNS)


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    order = sorted(HOST_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    hit = " OR ".join(f"regexp_matches(lower(url), '{pattern_regex(x)}', 's')" for x in PATTERNS)
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN {hit} THEN 'block' ELSE 'allow' END AS verdict
FROM cut
"""


ORACLE = {"op9_url_rules": _sql()}
