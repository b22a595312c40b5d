"""URL filters: pattern rules found by their rarest literal token.

A rule is a pattern in the notation of filter lists: ``*`` is anything, ``^`` a separator or the end, ``|`` at an end
anchors it there, ``||`` stands for the start of a host or of one of its parent domains, ``@@`` in front makes an
exception, and ``/.../`` is a regular expression. Case doesn't count.

A token is a run of two or more letters, digits and ``%``. A token of a pattern that no other character can
join in a URL must be a token of every URL that matches. Each rule is filed under the one of its tokens
that is in fewest URLs. A URL's tokens fetch the rules filed under them, and only these run their regular
expressions. A rule without such a token runs on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of pages that no corpus wants: advertising, tracking, affiliate links, adult content, gambling, pills, malware, and pages without text of their own.
DEFAULT_RULES = (
    "||ads.*^", "||adserver.*^", "||adservice.*^", "||doubleclick.net^", "||track.*^", "||tracking.*^", "||telemetry.*^", "/adserver/*", "/ads/*", "/banner-ads/*", "?affiliate=*", "&affiliate=*", "?aff_id=*", "&aff_id=*",
    "||adult.*^", "||porn.*^", "||xxx.*^", "/porn/*", "/xxx/*", "/nsfw/*", "||casino.*^", "-casino.*^", "||casino-*.*^", "||poker.*^", "/casino/*", "||betting.*^", "-bets.*^", "-pills.*^", "/viagra*", "||malware.*^", "||phishing.*^",
    "/wp-login.php", "/wp-admin/*", "^sessionid=*", "/cgi-bin/*^redirect^", r"/^[a-z]+:\/\/[^\/?#]*(?:porn|casino|viagra)/", "@@/robots.txt|", "@@||*.edu^", "@@||*.gov^",
)
_TOKEN = r"[a-z0-9%]{2,}"
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"
#: Rules whose tokens number up to this many are counted by a filter in the plan; more by a join.
IN_PLAN = 1000


@dataclass(frozen=True)
class Rule:
    text: str
    exception: bool
    regex: str
    tokens: tuple[str, ...]
    #: What lies between the asterisks; if each is found after the one before, at the first place, the rule matches. That takes linear time.
    parts: tuple[str, ...]


def parse(text: str) -> Rule:
    exception = text.startswith("@@")
    body = (text[2:] if exception else text).lower()
    if len(body) > 1 and body[0] == body[-1] == "/":
        # Lower-casing would turn \W into \w.
        raw = text[2:] if exception else text
        return Rule(text, exception, raw[1:-1], (), (raw[1:-1],))
    start = end = ""
    if body.startswith("||"):
        start, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*?\.)??", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = r"\Z", body[:-1]
    body = re.sub(r"\*+", "*", body)
    parts = ["".join(_SEPARATOR if c == "^" else re.escape(c) for c in x) for x in body.split("*")]
    parts[0] = start + parts[0]
    parts[-1] += end
    regex = "(?s)" + ".*".join(parts)
    tokens = []
    for m in re.finditer(_TOKEN, body):
        # "^" separates, so it closes a token; so do an anchor and any other literal. "*" and an open end don't.
        closed_left = body[m.start() - 1] != "*" if m.start() else bool(start)
        closed_right = body[m.end()] != "*" if m.end() < len(body) else bool(end)
        if closed_left and closed_right:
            tokens.append(m[0])
    return Rule(text, exception, regex, tuple(dict.fromkeys(tokens)), tuple(parts))


def parse_all(rules: Sequence[str]) -> list[Rule]:
    """The rules in their order; nulls, empty lines, comments (``!``) and rules whose expression is no regular expression are left out."""
    out = []
    for rule in (parse(r.strip()) for r in rules if r and r.strip() and not r.strip().startswith("!")):
        try:
            re.compile(rule.regex, re.ASCII)
        except re.error:
            continue
        out.append(rule)
    return out


def token_counts(urls: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """In how many rows of ``url`` each of ``tokens`` is, over all rows. What reaches the driver has a row for each token at most."""
    if not tokens:
        return {}
    spark = urls.sparkSession
    each = urls.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(url), '{_TOKEN}', 0)"))).alias("token"))
    if len(tokens) <= IN_PLAN:
        each = each.where(F.col("token").isin(list(tokens)))
    else:
        each = each.join(spark.createDataFrame([(t,) for t in tokens], "token string"), "token", "left_semi")
    return {r["token"]: r["count"] for r in each.groupBy("token").count().collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of the rules filed under each token, and of those without one. Of equally rare tokens the longest, then the least, is taken."""
    index: dict[str, list[int]] = {}
    rest = []
    for k, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(k)
        else:
            rest.append(k)
    return index, rest


class Matcher:
    def __init__(self, rules: Sequence[Rule], index: dict[str, list[int]], rest: list[int]):
        self.rules, self.index, self.rest = rules, index, rest
        self.compiled: dict[int, list[re.Pattern]] = {}
        self.runs = 0
        self._tokens = re.compile(_TOKEN).findall

    def match(self, url: str) -> tuple[int | None, int | None]:
        """The first blocking rule and the first exception that match."""
        low = url.lower()
        todo = set(self.rest)
        for t in self._tokens(low):
            found = self.index.get(t)
            if found:
                todo.update(found)
        first: list[int | None] = [None, None]
        for k in sorted(todo):
            side = self.rules[k].exception
            if first[side] is None:
                rx = self.compiled.get(k)
                if rx is None:
                    rx = self.compiled[k] = [re.compile(p, re.ASCII | re.DOTALL) for p in self.rules[k].parts]
                self.runs += 1
                at = 0
                for part in rx:
                    m = part.search(low, at)
                    if not m:
                        break
                    at = m.end()
                else:
                    first[side] = k
        return first[0], first[1]


def filter_urls(pages: DataFrame, rules: Sequence[str] = DEFAULT_RULES) -> DataFrame:
    """``page_id``, ``url``, ``rule``, ``exception`` and ``blocked`` of every page.

    ``rule`` and ``exception`` are the first of their kind that match, in the order of the list; ``blocked`` holds where there is a
    rule and no exception. A null or empty URL matches nothing and isn't blocked. Repeated pages have repeated
    results and null ids are carried. Other columns, whatever their names, play no part. Without rules
    nothing is blocked, and a rule that is no regular expression is as if it weren't there; without pages there are no rows. URLs
    of any length are read whole.
    """
    parsed = parse_all(rules)
    counts = token_counts(pages.select("url"), sorted({t for r in parsed for t in r.tokens}))
    sent = pages.sparkSession.sparkContext.broadcast((parsed, *build_index(parsed, counts)))

    def decide(urls: pa.Array) -> pa.Array:
        m = Matcher(*sent.value)
        found = [m.match(u) if u else (None, None) for u in urls.to_pylist()]
        names = [r.text for r in m.rules]
        rule, exception = ([None if f[k] is None else names[f[k]] for f in found] for k in (0, 1))
        blocked = [f[0] is not None and f[1] is None for f in found]
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(exception, pa.string()), pa.array(blocked, pa.bool_())], names=["rule", "exception", "blocked"])

    decide.__annotations__ = {"urls": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(decide, "struct<rule:string,exception:string,blocked:boolean>").asNondeterministic()
    return pages.select(F.col("page_id"), F.col("url"), udf(F.col("url")).alias("__r")).select("page_id", "url", "__r.*")


def oracle(rules: Sequence[str] = DEFAULT_RULES) -> str:
    """DuckDB SQL that tries every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(r.text)}, {str(r.exception).lower()}, {quote(r.regex.replace(chr(92) + 'Z', chr(92) + 'z'))})" for k, r in enumerate(parse_all(rules)))
    return f"""
WITH r(n, text, exception, rx) AS (VALUES {rows}),
p AS (SELECT row_number() OVER () AS k, page_id, url FROM pages),
m AS (SELECT k, min(n) FILTER (NOT exception) AS b, min(n) FILTER (exception) AS e FROM p JOIN r ON regexp_matches(lower(url), rx) GROUP BY k)
SELECT page_id, url, rb.text AS rule, re.text AS exception, b IS NOT NULL AND e IS NULL AS blocked
FROM p LEFT JOIN m USING (k) LEFT JOIN r rb ON rb.n = b LEFT JOIN r re ON re.n = e
"""
