"""URL filters: pattern rules indexed by their rarest literal token.

A rule needs some literal tokens (runs of letters and digits, whole ones) in
every URL that it fits. It is filed under the one of them that the fewest URLs
have. A URL's own tokens fetch its candidate rules; only those run their
regular expression. Cost per URL follows the candidates, not the rule set.

A null, empty or odd URL has an empty host and path and fits no rule; very long
ones are read whole. Of rules of equal rank the later text wins. Repeated rows
stay. Other columns stay too, but host, path and what the verdict adds replace
columns of these names. No rows in, no rows out.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.words import ascii_lower, whole

RULE = "struct<text:string,regex:string,verdict:string,rank:int>"
#: Up to so many rules travel inside the plan; larger sets are joined by token.
INLINE_RULES = 2000
TOKEN_GAP = "[^0-9a-z]+"


@dataclass(frozen=True)
class UrlRule:
    """``regex`` runs on host + path; of the rules that fit, the highest rank wins."""

    text: str
    regex: str
    verdict: str
    rank: int


def site_rule(verdict: str, text: str) -> UrlRule:
    """Rule ``host/path``: that host and its subdomains, paths that start so.

    Longer rules outrank shorter ones, and any of them outranks patterns.
    """
    host, slash, path = text.partition("/")
    tail = re.escape(slash + path) if slash else "(?=/|$)"
    return UrlRule(text, rf"^(?:[^/]*\.)?{re.escape(host)}{tail}", verdict, 1000 + len(text))


def word_rule(verdict: str, token: str) -> UrlRule:
    """Rule for hosts that have ``token`` between dots, hyphens and their ends; it may have hyphens itself."""
    return UrlRule(f"~{token}", rf"^(?:[^/]*[.-])?{re.escape(token)}(?=[./-]|$)", verdict, len(token))


#: Rules of the production query: sites first, then words of unwanted hosts.
SITE_RULES = (
    site_rule("block", "com/en/"),
    site_rule("allow", "example.com/en/7"),
    site_rule("allow", "net/de/"),
    site_rule("block", "example.net/de/8"),
    site_rule("block", "org/es/"),
)
#: Words of hosts that no corpus wants, and words that such hosts put before or after them.
UNWANTED = (
    "spam casino adult pills porn xxx viagra phishing malware poker slots roulette betting jackpot lottery escort hentai "
    "cialis steroids warez keygen cracked torrents serials payday replica clickbait adserver doubleclick popunder"
).split()
BEFORE = "free best online live top my the real cheap hot mega super play win buy get new royal lucky vip big fast easy pro".split()
AFTER = "online club world zone land city shop store hub now live club24 games game bonus deals site web net vip pro king express center".split()
WORD_RULES = tuple(
    word_rule("block", token)
    for word in UNWANTED
    for token in (word, *(f"{a}-{word}" for a in BEFORE), *(f"{word}-{b}" for b in AFTER))
)


def _edge(items) -> bool:
    """Whether what these parsed items match can't be a letter or digit (nor end in one)."""
    for op, arg in items:
        if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
            continue
        if op is sre.LITERAL and not chr(arg).isalnum():
            continue
        if op is sre.IN and all(o is sre.LITERAL and not chr(a).isalnum() for o, a in arg):
            continue
        return False
    return True


def literal_tokens(regex: str) -> set[str]:
    """Whole tokens that each match of ``regex`` has, lower-cased.

    Only literals at the top level count. A run of them is whole if what comes
    before and after can't be a letter or digit: an anchor, a literal such as
    ``.``, a class of such, or an optional group that ends in one at the start.
    """
    found, run, open_ = set(), "", True
    items = list(sre_parser.parse(regex))

    def closes(k: int) -> bool:
        op, arg = items[k]
        if op is sre.ASSERT:
            inner = list(arg[1])
            if len(inner) == 1 and inner[0][0] is sre.BRANCH:
                return all(_edge(b[:1]) for b in inner[0][1][1])
            return _edge(inner[:1])
        return _edge([items[k]])

    for k, (op, arg) in enumerate(items):
        if op is sre.LITERAL and chr(arg).isascii() and chr(arg).isalnum():
            run += chr(arg).lower()
            continue
        if run and open_ and closes(k):
            found.add(run)
        run = ""
        if op is sre.MAX_REPEAT and k and items[k - 1] == (sre.AT, sre.AT_BEGINNING):
            inner = list(arg[2])
            while len(inner) == 1 and inner[0][0] is sre.SUBPATTERN:
                inner = list(inner[0][1][3])
            open_ = arg[:2] == (0, 1) and bool(inner) and _edge(inner[-1:])
        else:
            open_ = _edge([items[k]])
    return found


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(whole(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return whole(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(subject), TOKEN_GAP))


def index_rules(subjects: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, list[UrlRule]]:
    """File each rule under its rarest literal token.

    ``subjects`` has one string column. Only tokens of rules are counted, so
    the result that reaches the driver is bounded by the rule set.
    """
    needs = {r: sorted(literal_tokens(r.regex)) for r in rules}
    if bare := [r.text for r in rules if not needs[r]]:
        raise ValueError(f"rules without a whole literal token: {bare}")
    every = sorted({t for ts in needs.values() for t in ts})
    if not every:
        return {}
    own = F.array_intersect(_tokens(F.col(subjects.columns[0])), F.from_json(F.lit(json.dumps(every)), "array<string>"))
    seen = {t: n for t, n in subjects.select(F.explode(own).alias("token")).groupBy("token").count().collect()}
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(needs[r], key=lambda t: (seen.get(t, 0), t)), []).append(r)
    return index


def _struct(r: UrlRule) -> dict:
    return {"text": r.text, "regex": r.regex, "verdict": r.verdict, "rank": r.rank}


def _best(fits: Column) -> Column:
    """The rule of the highest rank; between equals the later text."""
    return F.array_max(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["text"].alias("text"), r["verdict"].alias("verdict"))))


def match_urls(df: DataFrame, rules: tuple[UrlRule, ...], url: str = "url", inline_rules: int = INLINE_RULES) -> DataFrame:
    """Add ``host``, ``path`` and ``rule_hit`` (rank, text, verdict; null if no rule fits).

    Rows stay as they are, repeated ones too; a null or odd URL has an empty
    host and path and no rule. Columns of these names are replaced. With up to
    ``inline_rules`` rules nothing is shuffled. With more, distinct subjects
    meet the index in an equi-join on the token and come back by subject.
    """
    df = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    subject = F.concat("host", "path")
    index = index_rules(df.select(subject.alias("subject")), rules)
    if not index:
        return df.withColumn("rule_hit", F.lit(None).cast("struct<rank:int,text:string,verdict:string>"))
    if len(rules) <= inline_rules:
        table = F.from_json(F.lit(json.dumps({t: [_struct(r) for r in rs] for t, rs in index.items()})), f"map<string,array<{RULE}>>")
        keys = F.from_json(F.lit(json.dumps(sorted(index))), "array<string>")
        candidates = F.flatten(F.transform(F.array_intersect(_tokens(subject), keys), lambda t: table[t]))
        return df.withColumn("rule_hit", _best(F.filter(candidates, lambda r: F.rlike(subject, r["regex"]))))
    taken = {c.lower() for c in df.columns}
    key = next(f"_subject{k}" for k in range(len(taken) + 1) if f"_subject{k}" not in taken)
    listed = df.sparkSession.createDataFrame([(t, _struct(r)) for t, rs in index.items() for r in rs], f"token string, rule {RULE}")
    hits = (
        df.select(subject.alias("subject")).distinct()
        .select("subject", F.explode(_tokens(F.col("subject"))).alias("token"))
        .join(listed, "token")
        .filter(F.rlike("subject", F.col("rule.regex")))
        .groupBy(F.col("subject").alias(key)).agg(F.max(F.struct("rule.rank", "rule.text", "rule.verdict")).alias("rule_hit"))
    )
    return df.drop("rule_hit").join(hits, F.concat("host", "path") == F.col(key), "left").drop(key)


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = SITE_RULES + WORD_RULES, default: str = "allow") -> DataFrame:
    """Host, path, rule, pattern and verdict of each row.

    ``rule`` is the site rule that decides, null if there is none; then a word
    rule (``pattern``) decides, and else the verdict is ``default``.
    """
    hit = F.col("rule_hit")
    site = hit["rank"] >= 1000
    return (
        match_urls(df, rules, url)
        .withColumn("rule", F.when(site, hit["text"]))
        .withColumn("pattern", F.when(~site, hit["text"]))
        .withColumn("verdict", F.coalesce(hit["verdict"], F.lit(default)))
        .drop("rule_hit")
    )


def query(spark, sf_dir):
    """Every page's URL judged by the production rules."""
    from residuum.plans.tables import table

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "pattern", "verdict")


def _oracle() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return rf"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, rhost, rpath, v) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
j AS (
  SELECT u.*, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.v, length(r.rule)) AS v
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY u.page_id, u.host, u.path),
w AS (SELECT unnest({listed(UNWANTED)}) AS w),
t AS (
  SELECT w AS token FROM w
  UNION ALL SELECT a || '-' || w FROM w, (SELECT unnest({listed(BEFORE)}) AS a)
  UNION ALL SELECT w || '-' || b FROM w, (SELECT unnest({listed(AFTER)}) AS b)),
h AS (
  SELECT host, max(struct_pack(n := length(token), token := '~' || token)) AS best
  FROM (SELECT DISTINCT host FROM u) JOIN t ON regexp_matches(host, '(?s)^(.*[.-])?' || token || '([.-]|$)') GROUP BY host)
SELECT page_id, j.host, path, rule, CASE WHEN rule IS NULL THEN best.token END AS pattern,
  coalesce(v, CASE WHEN best IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN h ON j.host = h.host"""


ORACLE = _oracle()
