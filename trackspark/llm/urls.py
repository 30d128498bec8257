"""URL filters by pattern rules that are indexed by their rarest literal token.

A site rule (``host/path``) fits its host and all subdomains if the URL's path starts with the rule's; the longest
that fits decides. Where none fits, pattern rules decide: ``*`` stands for anything, ``^`` for a separator or the
end, ``||`` at the front for the start of a host label. Each rule is filed under that of its whole literal tokens
that is rarest among all URLs. A URL's tokens fetch candidate rules, and only those run their regular expression.
A rule without a whole token is filed under the empty token, which every URL has.

Null URL or one without ``://``: host and path are empty, the pattern rules see the empty text and the verdict is
the default. URLs are judged once each, so repeated rows get equal verdicts. An empty table gives an empty result.
Columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import helpers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The site rules of the registered query.
SITE_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Its pattern rules.
PATTERN_RULES = {"||ads.": "block", "||tracker.": "block", "*/login/*": "block", "*/wp-admin^": "block", "*?ref=x^": "block", "*&ref=x^": "block", "*sessionid=*": "block"}


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int


def _whole(text: str) -> tuple[str, ...]:
    """Literal tokens that a match holds as whole tokens: ``*`` and the ends may continue a token, separators may not."""
    return tuple(dict.fromkeys(re.findall(r"(?<![a-z0-9*\x01])[a-z0-9]+(?![a-z0-9*\x01])", text.translate(str.maketrans(UPPER, LOWER)))))


def site_rule(text: str, verdict: str) -> Rule:
    host, _, path = text.partition("/")
    # The path's end may continue in the URL.
    return Rule(text, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape('/' + path)}", _whole(f".{host}/{path}\x01"), len(text))


def pattern_rule(text: str, verdict: str) -> Rule:
    anchored = text.startswith("||")
    body = text[2:] if anchored else text
    regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(x, re.escape(x)) for x in body)
    return Rule(text, verdict, (r"^(?:[^/?#]*\.)?" if anchored else "") + regex, _whole(("." if anchored else "\x01") + body.replace("^", "/") + ("" if body.endswith("^") else "\x01")), 0)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host and path."""
    found = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return df.withColumns({"host": host_of(found), "path": F.regexp_extract(found, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)})


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.array_append(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), F.lit("")))


def filtered(df: DataFrame, site: dict[str, str] = SITE_RULES, patterns: dict[str, str] = PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``df`` with host, path, rule (the site rule that decides, or null) and verdict."""
    spark = df.sparkSession
    rules = [site_rule(*x) for x in site.items()] + [pattern_rule(*x) for x in patterns.items()]
    found = F.coalesce(F.col(url).cast("string"), F.lit(""))
    target = F.concat(host_of(found), F.regexp_extract(found, r"^[\s\S]*?://[^/?#]*([\s\S]*)", 1))
    distinct = df.select(found.alias("__url")).distinct().select("__url", F.concat(host_of(F.col("__url")), F.regexp_extract("__url", r"^[\s\S]*?://[^/?#]*([\s\S]*)", 1)).alias("__target"))
    tokens = distinct.select("__url", "__target", F.explode(_tokens(F.col("__target"))).alias("__token"))
    literal = sorted({t for r in rules for t in r.tokens})
    # As many counts as the rules have tokens.
    counts = {r["__token"]: r["n"] for r in tokens.where(F.col("__token").isin(literal)).groupBy("__token").agg(F.count("*").alias("n")).collect()}
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), r.text, r.verdict, r.regex, r.rank, bool(r.rank)) for r in rules]
    index = spark.createDataFrame(filed, "__token string, __rule string, __verdict string, __regex string, __rank int, __site boolean")
    # The rules' number is known here: a list beyond the bound is joined by Spark's own choice.
    index = F.broadcast(index) if len(filed) <= 100_000 else index
    fits = tokens.join(index, "__token").where(F.expr("__target rlike __regex"))
    best = fits.groupBy("__url").agg(F.max(F.struct("__rank", "__verdict", "__rule", "__site")).alias("__best"))
    names = [x for x in df.columns if x not in ("host", "path", "rule", "verdict")]
    own = helpers(df)
    best = best.select(F.col("__url").alias(f"{own}url"), F.col("__best").alias(f"{own}best"))
    judged = parts(df.select(*names), url).withColumn(f"{own}url", found).join(best, f"{own}url", "left")
    return judged.select(*names, "host", "path", F.when(F.col(f"{own}best.__site"), F.col(f"{own}best.__rule")).alias("rule"), F.coalesce(f"{own}best.__verdict", F.lit(default)).alias("verdict"))


#: The registered query in DuckDB's SQL, on the rules above.
SQL = r"""
with p as (select page_id, coalesce(url, '') as u from pages),
h as (select page_id, u, translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             case when instr(u, '://') > 0 then regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path,
             case when instr(u, '://') > 0 then regexp_extract(substr(u, instr(u, '://') + 3), '^[^/?#]*((?s:.*))', 1) else '' end as rest from p),
r as (select * from (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) as t(rhost, rpath, v)),
b as (select page_id, u, host, path, rest, max(struct_pack(n := length(rhost || rpath), v := v, rule := rhost || rpath)) filter (rhost is not null) as best
      from h left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all)
select page_id, host, path, best.rule as rule,
       case when best is not null then best.v
            when regexp_matches(host || rest, '^([^/?#]*\.)?(ads|tracker)\.|/login/|/wp-admin([^A-Za-z0-9_.%-]|$)|[?&]ref=x([^A-Za-z0-9_.%-]|$)|sessionid=') then 'block'
            else 'allow' end as verdict
from b
"""
