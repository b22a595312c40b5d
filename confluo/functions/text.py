"""Column expressions on strings, codes, dates and JSON."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo.functions.numeric import col


def _folds() -> tuple[str, str]:
    """Characters that are, by compatibility, one ASCII letter or digit with marks, then the marks themselves; and what stands for the first."""
    found = {}
    for k in chain(range(0xAA, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x2190), range(0xFF10, 0xFF5B)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[chr(k)] = plain
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


_ACCENTED, _PLAIN = _folds()
MONTHS = {"jan": 1, "fev": 2, "mar": 3, "abr": 4, "mai": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "out": 10, "nov": 11, "dez": 12}
#: Tried in this order, as some keywords contain others.
TYPE_KEYWORDS = {
    "nutrients": "albuminoid ammonia kjeldahl nitrate nitrite nitrogen phosph",
    "oxygen_demand_organic_load": "detergents hydrocarbons oils_and_grease organic_carbon oxygen_demand",
    "microbiological": "algae bacteria coliform coliphages escherichia fungi phytoplankton protozoa salmonella streptococci zooplankton",
    "metals": "zinc vanadium uranium tin silver selenium nickel mercury manganese lithium lead iron copper cobalt chromium cadmium boron bismuth beryllium barium arsenic aluminum",
    "organics_pesticides": "toxaphene phosdrin phenol parathion organophosphorus malathion lindane guthion ethion endrin endosulfan disulfoton diazinon demeton ddt chlor carbaryl bhc benz azinphos aldrin 2_4_",
    "core_physicochemical": "acidity alkalinity color conductivity fluorides hardness oxygen_saturation ph solids sulfates sulfides transparency turbidity",
}


def fold_accents(c: Column | str) -> Column:
    """Lower case without marks: what is one ASCII letter or digit by compatibility becomes it, and combining marks go."""
    return F.translate(F.lower(col(c)), _ACCENTED, _PLAIN)


def slugify(c: Column | str, empty: str = "run") -> Column:
    """Lower-case letters and digits of the folded text, runs of all else as one ``_``; ``empty`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", empty).otherwise(s)


def normalise_code(c: Column | str) -> Column:
    """A code as trimmed text without a trailing ``.0``; empty ones are null."""
    return F.nullif(F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", ""), F.lit(""))


def decimal_comma(c: Column | str, dash_is_zero: bool = False) -> Column:
    """Text such as ``1,5`` as a double; null where it is none. A lone dash may stand for 0."""
    s = F.trim(col(c))
    n = F.replace(s, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(s == "-", 0.0).otherwise(n) if dash_is_zero else n


def month_number(c: Column | str, months: Mapping[str, int] = MONTHS) -> Column:
    """The month that a text names by its first letters (accents and case don't count) or by number: ``2020-03``, ``03/2020``, ``_03_``."""
    s = fold_accents(c)
    name = F.regexp_extract(s, rf"(?:^|[^a-z])({'|'.join(months)})", 1)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(months.items())])
    patterns = (r"(?:19|20)\d\d[-_/.](0?[1-9]|1[0-2])(?!\d)", r"(?<!\d)(0?[1-9]|1[0-2])[-_/.](?:19|20)\d\d", r"[_-](0[1-9]|1[0-2])[_-]", r"(?:19|20)\d\d(0[1-9]|1[0-2])(?!\d)", r"^(0?[1-9]|1[0-2])$")
    found = [F.nullif(F.regexp_extract(s, p, 1), F.lit("")).try_cast("int") for p in patterns]
    return F.coalesce(F.try_element_at(table, F.nullif(name, F.lit(""))), *found)


def keyword_type(c: Column | str, keywords: Mapping[str, str] = TYPE_KEYWORDS) -> Column:
    """The first type of which a keyword is in the name; ``other`` if none is."""
    low = F.lower(col(c))
    out = F.when(low == "water_quality_index", "composite_indices")
    for name, words in keywords.items():
        out = out.when(low.rlike("|".join(words.split())), name)
    return out.otherwise("other")


def lookup(c: Column | str, table: Mapping, default: object = None) -> Column:
    """Value of a small driver-side table for a key, ``default`` if it isn't there."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(m, col(c)), F.lit(default))


def fixed_width(c: Column | str, layout: Mapping[str, tuple[int, int, str]]) -> list[Column]:
    """Fields of a text line by 1-based first and last place and type; what doesn't parse is null."""
    return [F.nullif(F.trim(F.substring(col(c), a, b - a + 1)), F.lit("")).try_cast(kind).alias(name) for name, (a, b, kind) in layout.items()]


def implied_decimal(c: Column | str, places_before: int = 3) -> Column:
    """Digits with a decimal point put after the first ``places_before`` of them."""
    s = F.trim(col(c))
    return F.concat(F.substring(s, 1, places_before), F.lit("."), F.substr(s, F.lit(places_before + 1))).try_cast("double")


def period_key(year: Column | str, quarter: Column | str, unit: Column | str) -> Column:
    """``2020_Q1_7``; a null unit is written ``<NA>``."""
    return F.concat(col(year).cast("string"), F.lit("_Q"), col(quarter).cast("string"), F.lit("_"), F.coalesce(col(unit).cast("string"), F.lit("<NA>")))


def two_digit_year(c: Column | str, pivot: int = 22) -> Column:
    y = col(c).cast("int")
    return F.when(y > pivot, y + 1900).otherwise(y + 2000)


def decade_bin(year: Column | str, start: int, width: int = 10) -> Column:
    """The right-closed bin ``(lo,hi]`` of a year, as its upper edge."""
    return (F.ceil((col(year) - start) / float(width)) * width + start).cast("int")


def date_of(date: Column | str, stamp: Column | str | None = None) -> Column:
    """A text or timestamp as a date, or else that of ``stamp``; null where neither parses."""
    parse = lambda c: F.to_date(F.try_to_timestamp(col(c).cast("string")))
    return parse(date) if stamp is None else F.coalesce(parse(date), parse(stamp))


def at_time(date: Column | str, time: Column | str) -> Column:
    """A date with a time of day given as a timestamp, ``H:M[:S]`` or the fraction of a day; midnight where there is none."""
    t = col(time).cast("string")
    part = lambda k: F.regexp_extract(t, r"(?:^|[ T])(\d{1,2}):(\d{2})(?::(\d{2}))?", k)
    clock = sum((F.coalesce(part(k).try_cast("int"), F.lit(0)) * n for k, n in ((1, 3600), (2, 60), (3, 1))), F.lit(0))
    fraction = t.try_cast("double")
    seconds = F.when(part(1) != "", clock).when((fraction >= 0) & (fraction < 1), F.round(fraction * 86400).cast("int")).otherwise(0)
    return F.timestamp_add("SECOND", F.coalesce(seconds, F.lit(0)), F.to_date(col(date)).cast("timestamp_ntz"))


def years_between(a: Column | str, b: Column | str) -> Column:
    return F.months_between(col(b), col(a)) / 12


def json_field(c: Column | str, path: str, kind: str = "string") -> Column:
    return F.get_json_object(col(c), path).try_cast(kind)


def links(html: Column | str, pattern: str = "") -> Column:
    """Targets of the links of a page that match ``pattern``, in order."""
    found = F.regexp_extract_all(col(html), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), 1)
    return F.filter(found, lambda x: x.rlike(pattern)) if pattern else found


def ordered_unique(columns: Sequence[Column | str]) -> Column:
    return F.array_distinct(F.filter(F.array(*[col(c) for c in columns]), lambda x: x.isNotNull()))
