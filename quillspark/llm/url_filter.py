"""URL verdicts: pattern rules indexed by their rarest literal token.

A rule's literal tokens are runs of letters and digits that a url must hold as whole tokens for the rule to fit. How many rows
hold each is counted over the table, each rule is filed under its rarest, and a url's tokens fetch the candidate rules; only
those run as regular expressions. Rules without a whole token are candidates for every url.

Domain rules (host and path, as `example.com/en/`) fit their host and its subdomains where the url's path starts with the rule's; the
longest that fits decides (equally long ones: the longer host, then block). Where none fits, pattern rules decide: any block pattern that
fits blocks; otherwise the url is allowed.

Defined results: a null url or one without `://` has an empty host and path, and is allowed; repeated rows are each judged;
other columns are ignored. The rule set is a parameter of at most MOST_RULES rules, checked before it is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 200_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. domain: host and path prefix; else pattern: literal text in which `*` stands for any run and `^` for a separator or the end."""

    verdict: str
    domain: str = ""
    pattern: str = ""

    @property
    def regex(self) -> str:
        if self.domain:
            return rf"(?:[^/]*\.)?{re.escape(self.domain)}"
        return "".join({"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in self.pattern)

    @property
    def tokens(self) -> set[str]:
        """Literal tokens bounded by other literal characters (or by the start of a domain), so that the url must hold them whole."""
        text = self.domain or self.pattern
        return {m[0] for m in TOKEN.finditer(text) if (m.start() > 0 and text[m.start() - 1] != "*" or m.start() == 0 and self.domain) and m.end() < len(text) and text[m.end()] != "*"}


def domain_rule(text: str) -> Rule:
    verdict, domain = text.split()
    return Rule(verdict, domain=domain)


#: The rules for domains, and the method's own patterns: fixed values.
DOMAIN_RULES = [domain_rule(x) for x in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")]
PATTERN_RULES = [
    Rule("block", pattern="://ads."),
    Rule("block", pattern="/ads/"),
    Rule("block", pattern="/advert/"),
    Rule("block", pattern="/banner/"),
    Rule("block", pattern="/login^"),
    Rule("block", pattern="/logout^"),
    Rule("block", pattern="/signup^"),
    Rule("block", pattern="/wp-admin/"),
    Rule("block", pattern="?sessionid="),
    Rule("block", pattern="&sessionid="),
    Rule("block", pattern="?phpsessid="),
    Rule("block", pattern="/cgi-bin/"),
    Rule("block", pattern=".exe^"),
    Rule("block", pattern=".zip^"),
    Rule("block", pattern="/tracker/*.gif^"),
    Rule("block", pattern="/calendar/*?date="),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.search(r"[/?#]", rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    path = re.split(r"[?#]", rest, maxsplit=1)[0]
    return re.sub(r"[A-Z]+", lambda x: x[0].lower(), host), path


def url_tokens(url: str | None) -> set[str]:
    return set(TOKEN.findall(re.sub(r"[A-Z]+", lambda x: x[0].lower(), url or "")))


def rule_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by rarest token; those without one under the empty token."""
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(i)
    return index


class Expressions:
    """The rules' regular expressions, each compiled when a url first asks for it."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.known = rules, {}

    def __getitem__(self, i: int) -> re.Pattern:
        if i not in self.known:
            self.known[i] = re.compile(self.rules[i].regex)
        return self.known[i]


def judged(url: str | None, rules: list[Rule], expressions: Expressions | list[re.Pattern], index: dict[str, list[int]]) -> tuple[str, str, str | None, str, str | None]:
    """host, path, domain rule, verdict, pattern that decided."""
    host, path = split_url(url)
    low = re.sub(r"[A-Z]+", lambda x: x[0].lower(), url or "")
    found = [i for t in (*url_tokens(url), "") for i in index.get(t, ())]
    fits = [r for i in found if (r := rules[i]).domain and host and expressions[i].match(host + path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.domain), len(r.domain.partition("/")[0]), r.verdict))
        return host, path, best.domain, best.verdict, None
    patterns = sorted(rules[i].pattern for i in found if not rules[i].domain and rules[i].verdict == "block" and expressions[i].search(low))
    return host, path, None, "block" if patterns else "allow", patterns[0] if patterns else None


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row."""
    rules = DOMAIN_RULES + PATTERN_RULES if rules is None else rules
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    tokens = sorted({t for r in rules for t in r.tokens})
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    seen = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token"))
    wanted = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    counts = {r["token"]: r["count"] for r in seen.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").count().collect()}
    shared = pages.sparkSession.sparkContext.broadcast((rules, rule_index(rules, counts)))

    def judge(batches):
        rules, index = shared.value
        expressions = Expressions(rules)
        for batch in batches:
            found = [judged(u, rules, expressions, index) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in range(5))], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string")
