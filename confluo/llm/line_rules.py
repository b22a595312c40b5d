"""Quality rules, line first: bad lines go, and then documents of which too much went.

Rules of a line, of which the first that it breaks counts:

* ``boilerplate``: a notice (copyright, licence, cookies, terms, subscription, script warnings);
* ``navigation``: menus and link bars, that is ``|``, ``>``, ``»`` or the like between most of its words, or nothing but menu words;
* ``punctuation``: over a seventh of its words carry runs of marks (``!!``, ``&&&``), or it has under four words and doesn't end
  a sentence;
* ``repetition``: of its words, six or more, under a quarter are different, or the same line came before in the document.

Lines are what newlines part. Blank ones count for nothing and go. Everything is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LOST = 0.5
RULES = ("boilerplate", "navigation", "punctuation", "repetition")

_BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (\(c\)|©|[0-9]{4})|© ?[0-9]{4}|licensed under|released under the|general public licen[sc]e|creative commons|terms (of|and) (use|service|conditions)"
    r"|privacy policy|cookie (policy|settings|consent)|(uses?|accept) cookies|enable javascript|subscribe to (our|the)|sign up for|click here|powered by|lorem ipsum"
    r"|todos los derechos reservados|pol[ií]tica de (privacidad|cookies)|tous droits r[ée]serv[ée]s|mentions l[ée]gales|politique de confidentialit[ée]|alle rechte vorbehalten|datenschutzerkl[äa]rung|allgemeine gesch[äa]ftsbedingungen)"
)
_BAR = r" [|»›>•·] "
#: Those that another one starts with come after it, so that taking the first that fits never needs to be undone.
_MENU_WORDS = (
    "home|menu|login|log in|sign in|sign up|register|search|contacto|contact|about us|about|next|previous|prev|back|top|share|tweet|print|sitemap|help|faq|skip to content|read more"
    "|inicio|buscar|siguiente|anterior|accueil|rechercher|suivant|startseite|kontakt|suche|weiter|impressum"
)
_MENU_GAP = "[ |/,>»·•-]"
_MENU_SQL = rf"(?i)^(({_MENU_WORDS}){_MENU_GAP}*)+\z"
#: The same, possessive: this engine then walks the words in a loop. Otherwise it recurses, and a menu of some thousand words overflows its stack.
_MENU = rf"(?i)^(?:(?:{_MENU_WORDS}){_MENU_GAP}*+)++\z"
_MARKS = r"(!!|\?\?|&&|%%|##|\$\$|\*\*|@@|==|~~|\+\+)"
_ENDS = r"[.!?…:;。！？][\"'”’»)\]]*\z"


#: A text without these has no line that the costlier expressions match, as each alternative holds one of them.
_HINTS = {
    "notice": "reserved copyright © licen released commons terms privacy cookie javascript subscribe sign click powered lorem reservados privacidad droits mentions politique vorbehalten datenschutz bedingungen".split(),
    "bar": list("|»›>•·"),
    "mark": "!! ?? && %% ## $$ ** @@ == ~~ ++".split(),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _any_in(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _hints(text: Column) -> Column:
    return F.struct(_any_in(F.lower(text), _HINTS["notice"]).alias("notice"), _any_in(text, _HINTS["bar"]).alias("bar"), _any_in(text, _HINTS["mark"]).alias("mark"))


def _words(line: Column) -> Column:
    """What blanks part. A split at one character needs no regular expression."""
    return F.array_remove(F.split(line, " "), "")


def _line_rule(line: Column, hints: Column | None = None) -> Column:
    hints = _hints(line) if hints is None else hints

    def rule(w: Column) -> Column:
        n = F.size(w)
        barred = _let(F.regexp_count(line, F.lit(_BAR)), lambda bars: (bars >= 2) & (bars * 3 >= n))
        return (
            F.when(hints["notice"] & line.rlike(_BOILERPLATE), "boilerplate")
            .when(hints["bar"] & barred | line.rlike(_MENU), "navigation")
            .when(hints["mark"] & (F.regexp_count(line, F.lit(_MARKS)) * 7 > n) | (n < 4) & ~line.rlike(_ENDS), "punctuation")
            .when((n >= 6) & (F.size(F.array_distinct(w)) * 4 < n), "repetition")
        )

    return _let(_words(line), rule)


def _blanked(text: Column) -> Column:
    """Tabs and carriage returns as blanks. Most texts have none and aren't copied."""
    return F.when(_any_in(text, ["\t", "\r"]), F.translate(text, "\t\r", "  ")).otherwise(text)


def _cleaned(text: Column) -> Column:
    """Non-blank lines, and the different ones of them with the rule that each breaks, if any."""
    lines = F.filter(F.transform(F.split(_blanked(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = lambda s: F.transform(F.array_distinct(s["l"]), lambda x: F.struct(x.alias("line"), _line_rule(x, s["h"]).alias("rule")))
    return _let(F.struct(lines.alias("l"), _hints(text).alias("h")), lambda s: F.struct(s["l"].alias("l"), marked(s).alias("m")))


def clean_lines(docs: DataFrame, *, most_lost: float = MOST_LOST) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_lines`` (not blank), lines removed by each rule (``n_boilerplate``, ``n_navigation``,
    ``n_punctuation``, ``n_repetition``), ``lost_share`` of the characters in lines, ``keep`` and the cleaned ``text``.

    A document is kept if something of it is left and at most ``most_lost`` of its characters went. Null and blank texts
    have no lines, a share of 1 and aren't kept; their cleaned text is empty. Repeated rows have repeated results,
    null ids are carried, other columns play no part, and an empty table gives no rows. Texts and lines may be of any length: every
    rule takes time in proportion to the line, and none recurses.
    """
    # A projection of its own keeps Spark from repeating this in each use.
    rows = docs.select(F.col("doc_id"), _cleaned(F.coalesce(F.col("text"), F.lit(""))).alias("__c"))
    rows = rows.select("doc_id", F.col("__c.l").alias("__l"), F.col("__c.m").alias("__m"))
    size = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    good = F.transform(F.filter("__m", lambda x: x["rule"].isNull()), lambda x: x["line"])
    broke = lambda r: F.size(F.filter("__m", lambda x: x["rule"] == r))
    count = {r: broke(r) for r in RULES}
    count["repetition"] = count["repetition"] + F.size("__l") - F.size("__m")
    rows = rows.select("doc_id", F.size("__l").alias("n_lines"), *(c.alias(f"n_{r}") for r, c in count.items()), size(F.col("__l")).alias("__all"), good.alias("__g"))
    rows = rows.select("*", size(F.col("__g")).alias("__left"))
    lost = F.when(F.col("__all") > 0, 1 - F.col("__left") / F.col("__all")).otherwise(1.0)
    keep = (F.col("__left") > 0) & (lost <= most_lost)
    return rows.select("doc_id", "n_lines", *(f"n_{r}" for r in RULES), F.round(lost, 6).alias("lost_share"), keep.alias("keep"), F.array_join("__g", "\n").alias("text"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle() -> str:
    counts = ",\n".join(f"CAST(len(list_filter(m, lambda x: x.rule = '{r}')) AS INT) AS n_{r}" for r in RULES[:3])
    return f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
o AS (SELECT doc_id, l, [x FOR x, i IN l IF list_position(l, x) = i] AS o FROM l),
m AS (SELECT doc_id, l, list_transform(o, lambda x: {{'line': x, 'rule': CASE
  WHEN regexp_matches(x, {_sql(_BOILERPLATE)}) THEN 'boilerplate'
  WHEN len(regexp_extract_all(x, {_sql(_BAR)})) >= 2 AND len(regexp_extract_all(x, {_sql(_BAR)})) * 3 >= len(string_split_regex(x, ' +')) OR regexp_matches(x, {_sql(_MENU_SQL)}) THEN 'navigation'
  WHEN len(regexp_extract_all(x, {_sql(_MARKS)})) * 7 > len(string_split_regex(x, ' +')) OR len(string_split_regex(x, ' +')) < 4 AND NOT regexp_matches(x, {_sql(_ENDS)}) THEN 'punctuation'
  WHEN len(string_split_regex(x, ' +')) >= 6 AND list_unique(string_split_regex(x, ' +')) * 4 < len(string_split_regex(x, ' +')) THEN 'repetition'
END}}) AS m FROM o),
g AS (SELECT *, list_transform(list_filter(m, lambda x: x.rule IS NULL), lambda x: x.line) AS g FROM m),
c AS (SELECT *, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS a, coalesce(list_sum(list_transform(g, lambda x: length(x))), 0) AS k FROM g)
SELECT doc_id, CAST(len(l) AS INT) AS n_lines, {counts},
CAST(len(list_filter(m, lambda x: x.rule = 'repetition')) + len(l) - len(m) AS INT) AS n_repetition,
CASE WHEN a > 0 THEN round(1 - CAST(k AS DOUBLE) / a, 6) ELSE 1.0 END AS lost_share,
k > 0 AND CASE WHEN a > 0 THEN 1 - CAST(k AS DOUBLE) / a ELSE 1.0 END <= {MOST_LOST} AS keep, array_to_string(g, chr(10)) AS text
FROM c
"""


ORACLE = _oracle()
