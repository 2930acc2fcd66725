"""Operator 4, URL filters by an index of rare literal tokens (native: DataFrame functions only).

Every rule, whether for a host and path or a pattern, becomes a regular expression together with the literal tokens
that any match must contain. Token frequencies are counted over all URLs; each rule is filed under its rarest token.
The distinct tokens of a URL fetch candidate rules by an equality join, and only those rules' expressions run. Work is
done once for each distinct URL and joined back, so a URL or host that holds much of the table costs one row.

The longest fitting host rule decides; without one, any fitting pattern blocks, else the URL is allowed. A rule in which
no token is literal is filed under a token that every URL has. `read_rules` takes lists of any length from a file.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is allowed; repeated
rows each get their verdict; columns other than `page_id` and `url` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import io

#: (host and path prefix, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Words of hosts that nobody wants to learn from: gambling, medicine, loans, adult sites, pirated files, trackers, spam.
WORDS = (
    "casino casinos poker roulette blackjack baccarat jackpot slots slot betting sportsbet bookmaker bookmakers lotto lottery bingo gamble gambling "
    "pills pill pharmacy viagra cialis levitra xanax tramadol steroids dietpills weightloss "
    "payday cashadvance quickloan quickloans fastcash easymoney getrich forex binaryoptions cryptodoubler giveaway freegift "
    "porn porno xxx sexcam sexcams livesex escorts milf hentai camgirls nudes "
    "warez crackz keygen keygens serialz nulled torrent torrents rapidgator "
    "ads adserver adservers adclick adsystem adtrack banner banners popunder popads clicktrack doubleclick tracker trackers pixel "
    "spam spammer bulkmail linkfarm seolinks backlinks autoblog doorway phishing malware ransomware spyware toolbar"
).split()
#: (expression over host and path, literal token that every match contains): a label of the host, or a part of one between
#: dashes, that isn't its last, is one of the words.
PATTERNS = tuple((rf"^([^/]*[.-])?{word}[.-][^/]*", word) for word in WORDS)
#: Rules are a parameter of the call; up to so many go to every executor, more are joined by a shuffle.
BROADCAST_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = "[^a-z0-9]+"
_FOLD = str.maketrans(_UPPER, _LOWER)
#: The token of rules without a literal token; every URL has it, so they are always candidates.
ANY = ""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _compiled(rules: tuple, patterns: tuple) -> list[tuple]:
    """(number, rule or null, verdict, length, regex, tokens)"""
    out = []
    for text, verdict in rules:
        host, slash, path = text.partition("/")
        host = host.translate(_FOLD)
        regex = rf"^([^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
        # a path prefix may end inside a token of the URL: only closed tokens are literal
        closed = [*re.split(_SPLIT, host), *re.split(_SPLIT, path.translate(_FOLD))[:-1]]
        out.append((len(out), text, verdict, len(text), regex, sorted({x for x in closed if x}) or [ANY]))
    for regex, token in patterns:
        found = sorted({x for x in re.split(_SPLIT, token.translate(_FOLD)) if x})
        out.append((len(out), None, "block", 0, regex, found or [ANY]))
    return out


def read_rules(spark: SparkSession, path: str) -> tuple[tuple, tuple]:
    """Rules and patterns from a text file: `allow host/path` or `block host/path`, or `pattern token expression`; lines
    that are empty or begin with # don't count. The list is a parameter of the call, so it comes to the driver."""
    rules, patterns = [], []
    for row in spark.read.text(path).collect():
        kind, _, rest = row["value"].strip().partition(" ")
        if kind in ("allow", "block"):
            rules.append((rest.strip(), kind))
        elif kind == "pattern":
            token, _, regex = rest.strip().partition(" ")
            patterns.append((regex.strip(), token))
        elif kind and not kind.startswith("#"):
            raise ValueError(f"not a rule: {row['value']}")
    return tuple(rules), tuple(patterns)


def judge(pages: DataFrame, rules: tuple = RULES, patterns: tuple = PATTERNS) -> DataFrame:
    """page_id, host, path, rule (of RULES, or null), verdict."""
    spark = pages.sparkSession
    rows = _compiled(rules, patterns)
    compiled = spark.createDataFrame(
        rows,
        "number int, rule string, rule_verdict string, length int, regex string, tokens array<string>",
    )
    bounded = F.broadcast if len(rules) + len(patterns) <= BROADCAST_RULES else lambda df: df
    host, path = parts(F.col("url"))
    urls = (
        pages.select("url")
        .distinct()
        .select("url", host.alias("host"), path.alias("path"))
        .withColumn("target", F.concat("host", "path"))
    )
    own = F.array_remove(F.array_distinct(F.split(F.translate("target", _UPPER, _LOWER), _SPLIT)), "")
    if any(ANY in row[-1] for row in rows):
        own = F.array_append(own, ANY)
    tokens = urls.select("url", "target", F.explode(own).alias("token"))
    literal = compiled.select("number", F.explode("tokens").alias("token"))
    seen = tokens.join(bounded(literal.select("token").distinct()), "token").groupBy("token").agg(
        F.count("*").alias("seen")
    )
    rarest = Window.partitionBy("number").orderBy(F.coalesce("seen", F.lit(0)), "token")
    index = (
        literal.join(seen, "token", "left")
        .withColumn("place", F.row_number().over(rarest))
        .filter("place = 1")
        .join(compiled.drop("tokens"), "number")
        .select("token", "number", "rule", "rule_verdict", "length", "regex")
    )
    hits = tokens.join(bounded(index), "token").filter(F.expr("target rlike regex"))
    best = hits.groupBy("url").agg(
        F.max(
            F.when(F.col("rule").isNotNull(), F.struct("length", F.length("rule"), "rule", "rule_verdict"))
        ).alias("best"),
        F.count("*").alias("fitting"),
    )
    verdicts = best.select(
        F.col("url").alias("hit_url"),
        F.col("best.rule").alias("hit_rule"),
        F.coalesce("best.rule_verdict", F.lit("block")).alias("hit_verdict"),
    )
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(
        verdicts, F.col("url") == F.col("hit_url"), "left"
    ).select(
        "page_id",
        "host",
        "path",
        F.col("hit_rule").alias("rule"),
        F.coalesce("hit_verdict", F.lit("allow")).alias("verdict"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(io.table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH rules(rule, rhost, rpath, v) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
  ('net/fr/', 'net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
p AS (SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT n, rule, v, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, rule DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.v, CASE WHEN regexp_matches(p.host, '(^|[.-])(WORDS)[.-]') THEN 'block' ELSE 'allow' END)
    AS verdict
FROM p LEFT JOIN fit f ON p.n = f.n AND f.k = 1
""".replace("WORDS", "|".join(WORDS))
