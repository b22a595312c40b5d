"""Secret scans by password guess cost.

What stands where a credential would (after ``token =``, ``password:``, ``Bearer``, between ``://user:`` and
``@``, in a PEM private key) is a secret if guessing it is dear. Its cost is the least sum of log10 guesses over all
ways of cutting it into dictionary words (also with capitals or digits for letters), dates, repeats,
keyboard walks, runs of letters or digits in order, references to a value that is elsewhere (``${NAME}``, ``<name>``, a call),
and brute-force characters. The dictionary is a short list of common passwords, followed by the whole words of a public tokenizer's
vocabulary in the order of their ids, which is about that of their frequency. A dynamic programme over
the ends of segments finds it; walks and runs grow by one step at a time, so the time is
linear in the length of the value.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import tokens
from confluo.llm.names import free_name

THRESHOLD = 10.0
#: Each further segment costs this much: a guesser must try where one ends.
JOIN = math.log10(2)

# Commonest first; the rank is the number of guesses.
COMMON = """123456 password 123456789 qwerty 12345678 111111 12345 abc123 password1 1234567 letmein welcome monkey dragon login
admin princess qwertyuiop solo passw0rd starwars master sunshine shadow football baseball superman michael batman trustno1 iloveyou
hello freedom whatever ninja mustang access flower hottie loveme secret summer winter spring autumn test guest user root changeme
default example sample placeholder your here token apikey api key value none null true false xxxx redacted hidden insert enter
replace todo dummy fake demo temp pass word auth bearer client server public private config string text name email house computer
internet service system account data cloud orange purple silver yellow green black white blue red happy family friend
correct horse battery staple coffee cookie chocolate cheese pepper ginger tiger eagle falcon hunter killer soccer hockey
january february march april june july august september october november december monday tuesday friday sunday""".split()
RANK = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
_LEET = str.maketrans("4@830!1$57", "aabeoiisst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_KEYS = {c: (x + 0.25 * r * (r > 0) + 0.25 * (r > 0), r) for r, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DATE = re.compile(r"(?a)(?:(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d|(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d)")
_YEAR = re.compile(r"(?a)(?:19|20)\d\d")
_BASE_YEAR = 2025

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|(?:auth|access|refresh|id|api|bearer|session)?[_-]?token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
# Letters may come before a name, as in dbPassword and PGPASSWORD, but not as the rest of these words.
_WORDS = "|".join(rf"(?<={x})pass(?![a-z])" for x in ("by", "com", "over", "sur", "tres", "under"))
_CONTEXT = re.compile(
    rf"""(?ai)(?!{_WORDS}){_NAME}["'\]]{{0,2}}\s{{0,4}}(?::=|=>|==?|:)\s{{0,4}}(?:"(?P<double>[^"\n]{{6,}})"|'(?P<single>[^'\n]{{6,}})'|(?P<bare>[^\s"'<>,;]{{6,}}))"""
    r"""|\bbearer\s+(?P<bearer>[A-Za-z0-9._~+/=-]{6,})|://[^\s/@:]*:(?P<url>[^\s/@]{6,})@"""
    r"""|-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<pem>[A-Za-z0-9+/=\s]{6,})-----END"""
)
#: Wider than every context, and cheap: texts without it aren't sent to Python.
_HINT = r"(?i)pass|pwd|secret|token|key|credential|auth|bearer|://[^\s/@:]*:[^\s/@]*@"


#: A reference names a value, and a placeholder asks for one; a guesser tries the usual ones.
REFERENCE = 3.0
_TEMPLATE = re.compile(r"\$\{[^{}]*\}|\{\{[^{}]*\}\}|\$\([^()]*\)|<[A-Za-z][\w .:-]*>|%[A-Za-z_]\w*%|\$[A-Z][A-Z0-9_]{2,}")
_CALL = re.compile(r"(?a)[A-Za-z_]+(?:\.[A-Za-z_]+)*(?:[\[(]|\([\w., ]*\)|\[[\w., ]*\])[)\];,.]*\Z")
_JOINED = re.compile(r"(?a)[A-Za-z]+(?:[-_ .][A-Za-z]+)*\Z")
_CUES = frozenset("your my example sample placeholder dummy fake insert enter replace changeme change todo here redacted hidden".split())


#: A word of prose has at most so many letters.
_PROSE = 20
#: Consonants that come after a consonant in words of European languages.
_FOLLOW = {x[0]: x[1:] for x in "bcdjlmprstv chklnqrst dbghjlmnrstvw flrst gdhlmnrst hlmnrtw j klnrstw lbcdfghkmnpstvwz mbflnpst nbcdfghjklmpqrstvwxz pcfhlmnrst q rbcdfghjklmnpqstvwz sbcdfghklmnpqrtw tbcfghlmnprswz vr wdhklmnrst xcfhpt zltw".split()}


def dictionary(tokenizer: bytes | None) -> dict[str, int]:
    """The rank of each word: common passwords, then the words of letters alone, of three or more, that a vocabulary of byte ranks has whole.

    It has as many entries as the vocabulary at most. Without one, or with another kind of file, it is the common passwords.
    """
    out = dict(RANK)
    if tokenizer and tokenizer[:1] != b"{":
        ranked = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, tokenizer.splitlines()))
        for _, token in ranked:
            word = token.decode(errors="ignore")
            if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                out.setdefault(word[1:].lower(), len(out) + 1)
    return out


def _word_cost(piece: str, words: dict[str, int] = RANK) -> float | None:
    low = piece.lower()
    plain = low.translate(_LEET)
    rank = words.get(low)
    cost = math.log10(rank) if rank else None
    if plain in words and (cost is None or words[plain] < rank):
        other = math.log10(words[plain]) + math.log10(2) * (plain != low) * sum(a != b for a, b in zip(plain, low))
        cost = other if cost is None else min(cost, other)
    if cost is None:
        return None
    upper = sum(c.isupper() for c in piece)
    if not upper:
        return cost
    return cost + math.log10(2 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else 2 + sum(math.comb(len(piece), k) for k in range(1, min(upper, len(piece) - upper) + 1)))


def _date_cost(text: str) -> float:
    year = int(_YEAR.search(text)[0])
    return math.log10(365 * max(abs(year - _BASE_YEAR), 20)) + math.log10(4) * any(not c.isdigit() for c in text)


def per_character(value: str) -> float:
    """log10 of the number of characters that a guesser would try at each place of this value."""
    if re.fullmatch(r"(?:[0-9a-f]+|[0-9A-F]+)", value) and not value.isdigit():
        return math.log10(16)
    n = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    n += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    return math.log10(max(n, 10))


def _near(a: str, b: str) -> tuple[float, float] | None:
    p, q = _KEYS.get(a), _KEYS.get(b)
    if not p or not q or a == b:
        return None
    d = (q[0] - p[0], q[1] - p[1])
    return d if abs(d[0]) <= 1.01 and abs(d[1]) <= 1 else None


_lengths: dict[int, int] = {}


def _longest(words: dict[str, int]) -> int:
    if len(words) not in _lengths:
        _lengths[len(words)] = max(map(len, words))
    return _lengths[len(words)]


_START_WALK, _STEP_ON, _STEP_TURN = math.log10(47), math.log10(1.2), math.log10(6)
_START_RUN, _STEP_RUN = math.log10(20), math.log10(1.1)


def segments(value: str, words: dict[str, int] = RANK) -> list[tuple[int, int, float]]:
    """Words, dates, repeats and references in a value as (start, end, log10 guesses), apart from brute force, walks and runs."""
    n, out = len(value), [(m.start(), m.end(), REFERENCE) for m in _TEMPLATE.finditer(value)]
    if _JOINED.match(value) and not _CUES.isdisjoint(re.split("[-_ .]", value.lower())):
        out.append((0, n, REFERENCE))
    longest = _longest(words)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            cost = _word_cost(value[i:j], words)
            if cost is not None:
                out.append((i, j, cost))
        m = _DATE.match(value, i)
        if m:
            out.append((i, m.end(), _date_cost(m[0])))
        m = _YEAR.match(value, i)
        if m:
            out.append((i, m.end(), math.log10(max(abs(int(m[0]) - _BASE_YEAR), 20))))
    rate = per_character(value)
    for unit in range(1, min(8, n // 2) + 1):
        i = 0
        while i + unit < n:
            j = i
            while j + unit < n and value[j] == value[j + unit]:
                j += 1
            times = (j - i) // unit + 1
            if times >= 2 and times * unit >= 3:
                word = _word_cost(value[i : i + unit], words)
                base = min(unit * rate, word if word is not None else math.inf)
                out.append((i, i + times * unit, base + math.log10(times)))
            i = max(j - unit + 1, i + 1) if times >= 2 else j + 1
    return out


def guess_cost(value: str, words: dict[str, int] = RANK) -> float:
    """The least log10 guesses over all segmentations of ``value``; 0 for an empty one."""
    n, rate = len(value), per_character(value)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in segments(value, words):
        ending[j].append((i, cost))
    best = [0.0] + [math.inf] * n
    brute, low, inf = [math.inf] * (n + 1), value.lower(), math.inf
    joined = lambda i: best[i] + (JOIN if i else 0.0)
    # Of a walk and of a run that reach this place: direction, cost if two keys long, cost if longer. Only the latter count.
    walk: tuple = (None, inf, inf)
    run: tuple = (None, inf, inf)
    for j in range(1, n + 1):
        brute[j] = rate + min(brute[j - 1], joined(j - 1))
        options = [brute[j], *(joined(i) + cost for i, cost in ending[j])]
        if j >= 2:
            d = _near(low[j - 2], low[j - 1])
            if d:
                walk = (d, joined(j - 2) + _START_WALK + _STEP_TURN, min(walk[1:]) + (_STEP_ON if walk[0] == d else _STEP_TURN))
            else:
                walk = (None, inf, inf)
            step = ord(value[j - 1]) - ord(value[j - 2])
            if step in (1, -1) and value[j - 2 : j].isascii() and value[j - 2 : j].isalnum():
                run = (step, joined(j - 2) + _START_RUN + _STEP_RUN, min(run[1:]) + _STEP_RUN if run[0] == step else inf)
            else:
                run = (None, inf, inf)
            options += [walk[2], run[2]]
        best[j] = min(options)
    return best[n]


def _wordlike(letters: str) -> bool:
    """Whether neighbouring consonants are those of words in Latin script, but for one pair in sixteen. Other scripts aren't judged."""
    plain = "".join(c for c in unicodedata.normalize("NFD", letters.lower()) if not unicodedata.combining(c))
    odd = sum(a in _FOLLOW and b in _FOLLOW and a != b and b not in _FOLLOW[a] or a == "q" and b != "u" for a, b in zip(plain, plain[1:]))
    return odd * 16 <= len(plain) - 1 and any(c not in _FOLLOW for c in plain)


def _prose(value: str) -> bool:
    """Whether an unquoted value is a plain word of prose, however rare: letters in a word's order, at most ``_PROSE`` of them."""
    m = re.fullmatch(r"([^\W\d_]+)[.,:;!?)*&%#$|]*", value)
    return m is not None and len(m[1]) <= _PROSE and not re.search(r"[a-z][A-Z]", m[1]) and _wordlike(m[1])


def findings(text: str, threshold: float = THRESHOLD, words: dict[str, int] = RANK) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, context, log10 guesses, whether it is a secret) of each value in a credential's place."""
    out = []
    for m in _CONTEXT.finditer(text):
        kind = m.lastgroup
        value = m[kind]
        bare = "".join(value.split()) if kind == "pem" else value
        cost = guess_cost(bare, words)
        if kind == "bare" and _CALL.match(bare):
            cost = min(cost, REFERENCE)
        out.append((m.start(kind), m.end(kind), kind, round(cost, 4), cost >= threshold and not (kind == "bare" and _prose(bare))))
    return out


_known: dict[bytes, dict[str, int]] = {}


def _send(docs: DataFrame, tokenizer: str | None) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(tokens.read_tokenizer(tokenizer) if tokenizer else b"")


def _words(sent: Broadcast) -> dict[str, int]:
    """The dictionary that a worker keeps."""
    key = hashlib.blake2b(sent.value).digest()
    if key not in _known:
        _known.clear()
        _known[key] = dictionary(sent.value)
    return _known[key]


def _finder(threshold: float, sent: Broadcast):
    def find(texts: pa.Array) -> pa.Array:
        words = _words(sent)
        rows = [[dict(zip(("start", "stop", "context", "log10_guesses", "secret"), f)) for f in findings(t, threshold, words)] if t else None for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("context", pa.string()), ("log10_guesses", pa.float64()), ("secret", pa.bool_())])))

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, "array<struct<start:int,stop:int,context:string,log10_guesses:double,secret:boolean>>").asNondeterministic()


def _hinted(text: Column) -> Column:
    return F.when(text.rlike(_HINT), text)


def scan_secrets(docs: DataFrame, *, threshold: float = THRESHOLD, tokenizer: str | None = None) -> DataFrame:
    """A row for each value in a credential's place: ``doc_id``, ``start`` and ``stop`` in characters, ``context``,
    ``log10_guesses`` and ``secret`` (guessing takes at least 10**threshold tries). The value itself isn't shown.

    Null, empty and other texts without such a place give no rows; repeated documents give repeated rows; null ids
    are carried. Values of six characters or more are taken, whole, however long; shorter ASCII ones can't reach the
    threshold. ``tokenizer`` is the path of a vocabulary that the dictionary is taken from. Other columns play no part.
    """
    udf = _finder(threshold, _send(docs, tokenizer))
    hits = docs.select(F.col("doc_id"), F.col("text").alias("__t")).where(F.col("__t").rlike(_HINT)).select("doc_id", udf(F.col("__t")).alias("__f"))
    return hits.where(F.size("__f") > 0).select("doc_id", F.explode("__f").alias("__f")).select("doc_id", "__f.*")


def redact_secrets(docs: DataFrame, *, threshold: float = THRESHOLD, mark: str = "[SECRET]", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with each secret of :func:`scan_secrets` in ``text`` replaced by ``mark``; every row stays.

    ``n_chars``, where there is one, becomes the new length of a changed text. Other texts, null and
    empty ones among them, and all other columns stay as they were.
    """

    sent = _send(docs, tokenizer)

    def clean(texts: pa.Array) -> pa.Array:
        out, words = [], _words(sent)
        for t in texts.to_pylist():
            spans = [f for f in findings(t, threshold, words) if f[4]] if t else []
            if not spans:
                out.append(None)
                continue
            parts, at = [], 0
            for start, stop, *_ in spans:
                parts += [t[at:start], mark]
                at = stop
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    clean.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(clean, "string").asNondeterministic()
    made = free_name(docs, "__confluo_clean")
    new = docs.withColumn(made, udf(_hinted(F.col("text"))))
    changed = {"text": F.coalesce(made, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col(made).isNotNull(), F.length(made)).otherwise(F.col("n_chars")).cast(kind)
    return new.withColumns(changed).drop(made)
