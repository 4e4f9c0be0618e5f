"""Secret scans: fixed patterns, and password guess cost by dynamic programming.

Besides the fixed patterns, values that stand in a credential context ("pwd: x",
"Authorization: Bearer x") are weighed by the guesses an attacker needs. A value is
cut into dictionary words, dates, repeats, keyboard walks and sequences, and
brute-force characters; the cheapest cut is its cost, in powers of ten. Values that
cost at least ``min_log10`` are secrets; cheap ones are placeholders or prose. After "is", where prose
is likelier, a value must also not consist of dictionary words for the most part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import default_vocabulary, read_tokens
from .common import map_texts

#: Kinds of spans in the order that breaks ties.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A keyword, within an identifier or not, what may end the identifier, a separator and the value.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|\bauth(?:orization)?)"""
    r"""(?ai:[_-]?(?:key|id|token|value|string|hash|secret|access[_-]key|prod|dev|test)s?|s)?[0-9]{0,3}["'`]?\x20*"""
    r"""(?:[:=]+>?|(?P<prose>(?ai:is)\x20))\x20*(?:(?ai:bearer|basic)\x20+)?["'`]?(?P<value>[^\s"'`<>]+)"""
)
#: Each text that holds a match of ASSIGN or CONTEXT holds one of these, in some case.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "auth")

#: Part of a value's letters in dictionary words from which on a value after "is" counts as prose.
MAX_WORD_SHARE = 0.75
#: Common password words, the most frequent first.
WORDS = (
    "password pass qwerty admin welcome letmein monkey dragon master login princess sunshine shadow football "
    "baseball superman michael jordan hello freedom whatever trust summer winter spring autumn secret test "
    "user root guest default changeme example sample token key server system office company internet computer "
    "love money happy flower cookie cheese pepper ginger hunter ranger tiger eagle falcon soccer hockey batman "
    "starwars pokemon matrix thunder silver golden orange purple yellow black white green blue red apple banana "
    "lemon cherry chocolate coffee charlie daniel jessica ashley thomas robert andrew joshua matthew jennifer "
    "george london paris berlin madrid january february march april june july august september october november "
    "december monday tuesday wednesday thursday friday saturday sunday access temp demo dev prod my the"
).split()
#: Rows of a keyboard, for walks along them.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Usual substitutes of letters.
LEET = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")

#: What is no secret whatever it costs: addresses, times, grouped numbers, and code that fetches one.
PLAIN = re.compile(
    r"(?ai:[a-z][a-z0-9+.-]*://.*)|[0-9]{1,3}(?:[,.][0-9]{3})+|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?:T[0-9:.]+(?:Z|[+-][0-9:]+)?)?|(?a:[A-Za-z_]\w*(?:\.\w+)*[(\[][\w.,]*)"
)

DATE_COST = math.log10(119 * 365)
YEAR_COST = math.log10(119)
JOIN_COST = math.log10(2)
UNIT = 8


def dictionary(path: str | None = None) -> tuple[str, ...]:
    """Words, the most frequent first: WORDS, then those of 3 to 16 letters that a public tokenizer's rank file holds.

    Ranks of such a file follow frequency in the text it was made from. There are some 30,000 words."""
    tokens, _ = read_tokens(path or default_vocabulary()[0])
    whole = (t.decode(errors="ignore").strip().lower() for t in tokens)
    return (*WORDS, *dict.fromkeys(w for w in whole if 3 <= len(w) <= 16 and w.isascii() and w.isalpha() and w not in WORDS))


def _neighbours() -> set[str]:
    pairs = set()
    for row in ROWS:
        pairs |= {a + b for a, b in zip(row, row[1:])}
    for upper, lower in zip(ROWS, ROWS[1:]):
        for shift in (0, 1):
            pairs |= {a + b for a, b in zip(upper[shift + 1 :], lower)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs |= {a + b for a, b in zip(letters, letters[1:])}
    return pairs | {p[::-1] for p in pairs}


def brute_cost(char: str) -> float:
    if char.isdigit():
        return 1.0
    if char.isalpha():
        return math.log10(26) if char.isascii() else 2.0
    return math.log10(33) if char.isascii() else 2.0


def guess_cost(words: tuple[str, ...] = tuple(WORDS)) -> Callable[[str], float]:
    """Function of a value: log10 of the guesses of its cheapest segmentation.

    Time grows in proportion to the value's length. The function's ``word_share`` is the part of the last value's
    letters that this segmentation took as words."""
    rank = {w: math.log10(i) for i, w in reversed(list(enumerate(words, 1)))}
    longest = max(map(len, rank), default=0)
    adjacent = _neighbours()
    walk_start, walk_step = math.log10(47), math.log10(1.5)

    def cost(value: str) -> float:
        n = len(value)
        lower = value.lower() if value.isascii() else value
        plain = lower.translate(LEET)
        walk = [1] * (n + 1)  # length of the keyboard walk that ends before each position
        for i in range(1, n):
            walk[i + 1] = walk[i] + 1 if lower[i - 1] + lower[i] in adjacent else 1
        found: dict[int, list[tuple[int, float]]] = {}
        for pattern, price in ((DATE, DATE_COST), (YEAR, YEAR_COST)):
            for m in pattern.finditer(value):
                found.setdefault(m.end(), []).append((m.start(), price))
        best, in_words = [0.0] * (n + 1), [0] * (n + 1)
        runs = [[1] * (n + 1) for _ in range(UNIT + 1)]  # repeats of a unit that end before each position
        for j in range(1, n + 1):
            low, held = best[j - 1] + brute_cost(value[j - 1]), in_words[j - 1]
            for i in range(max(0, j - longest), j - 1):
                price = rank.get(plain[i:j])
                if price is not None:
                    price += JOIN_COST * ((value[i:j] != lower[i:j]) + (lower[i:j] != plain[i:j]))
                    if best[i] + price + JOIN_COST < low:
                        low, held = best[i] + price + JOIN_COST, in_words[i] + j - i
            others = list(found.get(j, ()))
            if walk[j] >= 3:
                others.append((j - walk[j], walk_start + walk_step * (walk[j] - 1)))
            for unit in range(1, min(UNIT, j // 2) + 1):
                if value[j - unit : j] == value[j - 2 * unit : j - unit]:
                    times = runs[unit][j] = runs[unit][j - unit] + 1
                    if times * unit >= 3:
                        i = j - times * unit
                        others.append((i, sum(map(brute_cost, value[i : i + unit])) + math.log10(times)))
            for i, price in others:
                if best[i] + price + JOIN_COST < low:
                    low, held = best[i] + price + JOIN_COST, in_words[i]
            best[j], in_words[j] = low, held
        cost.word_share = in_words[n] / max(1, sum(map(str.isalpha, value)))
        return best[n]

    return cost


def spans(text: str, cost: Callable[[str], float], min_log10: float) -> list[tuple[int, int, int, float | None]]:
    """(kind's number, start, end, log10 guesses), in order of start, then kind."""
    out: list[tuple[int, int, int, float | None]] = []
    lower = text.lower()
    hinted = any(h in lower for h in HINTS)
    if hinted:
        out += [(0, *m.span(), None) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, *m.span(), None) for m in HEX.finditer(text)]
    if hinted:
        base = sorted((a, b) for _, a, b, _ in out)
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".,;:!?)]}")
            start, end = m.start("value"), m.start("value") + len(value)
            # what overlaps a base span is reported there; a credential within an address is still weighed
            if any(a < end and start < b for a, b in base) or (PLAIN.fullmatch(value) and "@" not in value):
                continue
            price = cost(value)
            if price >= min_log10 and not (m["prose"] and cost.word_share >= MAX_WORD_SHARE):
                out.append((3, start, end, price))
    return sorted(out, key=lambda s: (s[1], s[0]))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_log10: float = 10.0,
    words: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, spans array<struct<kind, start, end, log10_guesses>>.

    Positions count code points, ends are exclusive; base kinds have null guesses. A
    context value inside a base span is not reported again. Null and empty texts have
    no spans; repeated rows each return their row; other columns are ignored; an empty
    table gives an empty result. ``words`` (by default ``dictionary()``) are broadcast: a parameter of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary() if words is None else words)

    def per_text() -> Callable[[str], tuple]:
        cost = guess_cost(shared.value)

        def one(text: str) -> tuple:
            return ([{"kind": KINDS[k], "start": a, "end": b, "log10_guesses": g} for k, a, b, g in spans(text, cost, min_log10)],)

        return one

    schema = "spans array<struct<kind: string, start: int, end: int, log10_guesses: double>>"
    return map_texts(docs, id_col, text_col, schema, per_text, encoded=False)


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
