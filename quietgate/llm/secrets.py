"""Secret scan: base patterns, and values in a credential's place that are dear to guess.

A value's guess cost is the least sum, over all ways to cut it, of the costs of its pieces:
words, dates, repeated units, keyboard walks and brute-force stretches. Costs are decimal
logarithms of the number of guesses.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, texts, tidy

KINDS = ("assign", "access", "hex", "guess")

# The base patterns. ASCII letters alone match in either case.
_ASSIGN = re.compile(
    r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_GATE = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Names that put a credential after them, wider than the base.
_CONTEXT_GATE = ("pass", "pwd", "secret", "token", "key", "bearer", "credential", "auth")
# A name may follow another after "_", "-", "." or a change of case: DB_PWD, sshPrivateKey.
_BLANK = r"[^\S\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"""
    r"""(?ia:(?:password|passphrase|passwd|pass|pwd|secret|token|api[_-]?key|access[_-]?key"""
    r"""|private[_-]?key|bearer|credentials?|authorization|auth))["']?"""
    rf"""(?:{_BLANK}*+(?:[:=]=?>?|\bis\b)|(?<=[Rr])(?={_BLANK})){_BLANK}*+"""
)
# A value in quotes ends at its own quote, on the same line; one without at a blank, a quote, a
# comma, a semicolon, an angle bracket, or the first closing bracket that it did not open.
_QUOTED = {q: re.compile(rf"[^{q}\n\r]*+(?={q})") for q in "\"'`"}
_BARE = re.compile(r"""[^\s"'`,;<>\x00-\x20\x7f]*+""")
_OPENED = {")": "(", "]": "[", "}": "{"}
LEAST_VALUE = 6

# Words people use in passwords, most used first.
WORDS = tuple(
    "password admin welcome letmein login master secret dragon monkey love sunshine princess "
    "football baseball shadow michael superman batman trustno hello freedom whatever qazwsx "
    "iloveyou computer internet access summer winter spring autumn flower purple orange yellow "
    "green black white silver golden tiger eagle falcon wizard hunter ranger killer soccer "
    "hockey jordan charlie daniel thomas robert george andrew joshua matthew jennifer jessica "
    "ashley amanda nicole hannah maggie ginger pepper cookie cheese banana chocolate coffee "
    "guitar music money server system root user guest test default change changeme temp demo "
    "sample example private public token account service manager office company family mother "
    "father sister brother friend forever happy lucky angel heaven star moon sun fire water "
    "earth storm thunder lightning phoenix unicorn diamond crystal magic mystery the and you "
    "for my me one two three four five six seven eight nine zero day night year monday friday "
    "january june july august december".split()
)
_KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_LEET = str.maketrans("4301$5@7!", "aeolssati")
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
_LONGEST_DATE = 10
#: A repeated piece is a unit of at most so many characters, said at least twice.
REPEAT_UNIT = 16


def _walk_steps() -> frozenset[str]:
    """Pairs of neighbouring keys (or alphabet letters), both ways."""
    pairs = set()
    for row in _KEY_ROWS:
        pairs.update(row[i : i + 2] for i in range(len(row) - 1))
    for upper, lower in zip(_KEY_ROWS[:3], _KEY_ROWS[1:4]):
        for i, key in enumerate(upper):
            pairs.update(key + x for x in lower[max(0, i - 1) : i + 1])
    return frozenset(pairs | {p[::-1] for p in pairs})


_STEPS = _walk_steps()
_RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_SEGMENT = 0.3  # each further piece doubles the guesses


def _char_cost(value: str) -> float:
    kinds = (
        26 * any(c.islower() for c in value)
        + 26 * any(c.isupper() for c in value)
        + 10 * any(c.isdigit() for c in value)
        + 33 * any(not c.isalnum() for c in value)
        + 100 * (not value.isascii())
    )
    if set(value) <= set("0123456789abcdef"):
        kinds = 16
    return math.log10(max(kinds, 10))


class _Starts:
    """Least of ``cost + log10(end - origin)`` over all starts so far, for ends that only grow.

    An earlier start of lower cost overtakes a later one once and for good, so the starts are a
    stack in the order in which they will be overtaken; each goes in and out once.
    """

    __slots__ = ("stack",)

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []  # origin, cost, end when the one below is better

    def add(self, origin: int, cost: float) -> None:
        stack = self.stack
        while stack:
            low, least, until = stack[-1]
            if least < cost:
                ratio = 10.0 ** min(cost - least, 300.0)
                end = (origin * ratio - low) / (ratio - 1.0) if ratio > 1.0 else math.inf
                if end < until or len(stack) == 1:
                    stack.append((origin, cost, end))
                    return
            stack.pop()
        stack.append((origin, cost, math.inf))

    def least(self, end: int) -> float:
        stack = self.stack
        while len(stack) > 1 and stack[-1][2] <= end:
            stack.pop()
        return stack[-1][1] + math.log10(end - stack[-1][0]) if stack else math.inf


#: Least costs of so many last places are kept: more than any word, date or unit is long.
_RING = 64


class Words(dict):
    """The cost of each word, by its place in a ranking, and the lengths that occur."""

    def __init__(self, costs: dict[str, float]) -> None:
        super().__init__({w: c for w, c in costs.items() if len(w) < _RING})
        self.lengths = sorted({len(w) for w in self})


COMMON = Words(_RANK)


def guess_cost(value: str, words: Words = COMMON) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs.

    A walk has three keys or more and may begin anywhere in a run of neighbouring keys; a repeat
    says its unit once, at the unit's own cost, and then any number of times. Linear in the
    value's length, and a window of it is held; the empty value costs 0.
    """
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a few letters are two in lower case
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(_LEET)
    char = _char_cost(value) if n else 0.0
    pieces: dict[int, list[tuple[int, float]]] = {}  # by end: start, cost
    run, walks = 0, _Starts()  # the run of neighbouring keys up to here, and walks from its keys
    best = [math.inf] * _RING  # by place modulo the ring
    best[0] = brute = 0.0  # brute: best ending in a brute-force stretch
    runs = [0] * (REPEAT_UNIT + 1)  # characters up to here that equal those a unit before
    repeats: list[list[_Starts]] = [[] for _ in range(REPEAT_UNIT + 1)]  # by end modulo the unit
    for end in range(1, n + 1):
        i = end - 1
        for size in words.lengths:
            if i + size > n:
                break
            cost = words.get(plain[i : i + size])
            if cost is not None:
                piece = value[i : i + size]
                cost += 0.3 * (piece != piece.lower()) + 0.5 * (low[i : i + size] != plain[i : i + size])
                pieces.setdefault(i + size, []).append((i, cost))
        if low[i].isdigit():
            m = _DATE.match(low, i, min(n, i + _LONGEST_DATE))
            if m:
                pieces.setdefault(m.end(), []).append((i, 2.1 if m.end() - i == 4 else 4.6 + 0.6 * (m.end() - i > 8)))
                if m.end() - i > 4 and low[i : i + 2] in ("19", "20") and low[i + 2 : i + 4].isdecimal():
                    pieces.setdefault(i + 4, []).append((i, 2.1))  # the year alone
        opened = best[i % _RING] + (_SEGMENT if end > 1 else 0.0)
        brute = (min(brute, opened) if end > 1 else opened) + char
        least = brute
        if end > 1 and low[end - 2 : end] not in _STEPS:
            run, walks = end - 1, _Starts()
        if end - run >= 3:
            first = end - 3
            walks.add(first, best[first % _RING] + (_SEGMENT if first else 0.0))
            least = min(least, walks.least(end) + 1.7)
        for start, cost in pieces.pop(end, ()):
            least = min(least, best[start % _RING] + cost + (_SEGMENT if start else 0.0))
        for unit in range(1, min(REPEAT_UNIT, end - 1) + 1):
            runs[unit] = runs[unit] + 1 if value[end - 1] == value[end - 1 - unit] else 0
            if runs[unit] == 1:
                repeats[unit] = [_Starts() for _ in range(unit)]
            fewest = max(1, 3 // unit - 1)
            if runs[unit] >= fewest * unit:
                # The unit stands once at its own cost; the rest only says how often.
                first, starts = end - fewest * unit, repeats[unit][end % unit]
                starts.add(first - unit, best[first % _RING])
                least = min(least, starts.least(end) - math.log10(unit) + _SEGMENT)
        best[end % _RING] = least
    return best[n % _RING] if n else 0.0


#: A credential's value of at least 10^10 guesses is taken for a real secret.
MIN_COST = 10.0


def value_at(text: str, at: int) -> tuple[int, int] | None:
    """Where the value is that a credential's name and sign put at ``at``, if it is long enough."""
    if text[at : at + 1] in _OPENED.values() and text[at + 1 : at + 2] in _QUOTED:
        at += 1
    quote = text[at : at + 1]
    if quote in _QUOTED:
        at += 1
        m = _QUOTED[quote].match(text, at)
        if m:
            return m.span() if m.end() - at >= LEAST_VALUE else None
    m = _BARE.match(text, at)
    end = m.end()
    open_: list[str] = []
    for i in range(at, end):
        c = text[i]
        if c in "([{":
            open_.append(c)
        elif c in ")]}":
            if not open_ or open_.pop() != _OPENED[c]:
                end = i
                break
    while end > at and text[end - 1] in ".:!?":
        end -= 1
    return (at, end) if end - at >= LEAST_VALUE else None


def values(text: str, low: str | None = None) -> Generator[tuple[int, int], bool | None, None]:
    """The values in credentials' places. A sender may ask, by sending True, that what follows
    begins at the value's start: it was the next name."""
    if not any(x in (low or text.lower()) for x in _CONTEXT_GATE):
        return
    m = _CONTEXT.search(text)
    while m:
        found = value_at(text, m.end())
        again = (yield found) if found else None
        m = _CONTEXT.search(text, m.end() if again or not found else found[1])


def find(
    text: str, min_cost: float = MIN_COST, words: Words = COMMON
) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, added spans (start, kind's index, end) in order, and the dearest value's cost."""
    base: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_GATE):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    added, dearest = [], 0.0
    at, reach = 0, -1
    asked = values(text, low)
    found = next(asked, None)
    while found:
        start, end = found
        cost = guess_cost(text[start:end], words)
        # A cheap value without a sign may be the next name: Authorization: Bearer ...
        named = cost < min_cost and not any(x in text[start : end - 1] for x in ":=")
        dearest = max(dearest, cost)
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][2])
            at += 1
        if cost >= min_cost and reach < end:
            added.append((start, 3, end))
        try:
            found = asked.send(named)
        except StopIteration:
            break
    return base, added, dearest


#: Of the words of a table the most frequent so many are learned, and none that is in a smaller
#: share of its documents, or in fewer than three of them.
WORDS_LEARNED, LEAST_SHARE, LEAST_DOCS = 20_000, 1e-4, 3
_LETTERS = re.compile(r"[^\W\d_]{3,20}")
#: Distinct words that a task holds before it passes them on.
_HELD = 1 << 18


def learned_words(docs: DataFrame, most: int = WORDS_LEARNED) -> Words:
    """Costs of the common words and of the table's own, ranked by the documents that hold them.

    Words count outside credentials' places alone, so that a secret in thousands of copies of a
    document does not become a word. ``most`` bounds what reaches the driver and the tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                held[""] += 1  # documents
                cuts = list(values(text))
                for start, end in reversed(cuts):
                    text = text[:start] + " " + text[end:]
                held.update(set(_LETTERS.findall(text.lower())))
            if len(held) > _HELD:
                yield record(schema, zip(*held.items()))
                held.clear()
        if held:
            yield record(schema, zip(*held.items()))

    counts = texts(docs).select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counts.orderBy(F.desc("n"), "word").limit(most + 1).collect()  # the documents come first
    total = next((r["n"] for r in best if not r["word"]), 0)
    least = max(LEAST_DOCS, LEAST_SHARE * total)
    ranked = [r["word"] for r in best if r["word"] and r["n"] >= least][:most]
    costs = {w: math.log10(len(WORDS) + i + 2) for i, w in enumerate(ranked)}
    return Words(costs | _RANK)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
        ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
        ("n_guess", pa.int64()), ("max_guess_cost", pa.float64()),
    ]
)


def secrets(docs: DataFrame, min_cost: float = MIN_COST, words: Words | None = None) -> DataFrame:
    """One row per document: counts of each kind, the base spans' digest and all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. A null
    text is an empty one; repeated rows are answered once each; a null id stays null. Values
    found by guess cost are added where no base span already reaches their end. ``words`` are
    those that a guesser tries, by default the common ones and the table's own; but for their
    counts nothing is shuffled.
    """
    known = _shared(docs, words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                base, added, dearest = find(text.as_py(), min_cost, known.value)
                count = [0, 0, 0]
                for _, k, _ in base:
                    count[k] += 1
                digest = hashlib.sha256(spell(base).encode()).hexdigest()
                rows.append((doc, *count, digest, spell(sorted(base + added)), len(added), dearest))
            if rows:
                yield record(_FOUND, zip(*rows))

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
        " n_guess long, max_guess_cost double"
    )
    ids = F.col("doc_id").cast("long").alias("doc_id")
    return texts(docs).select(ids, "text").mapInArrow(tidy(scan), schema)


def _shared(docs: DataFrame, words: Words | None) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(learned_words(docs) if words is None else words)


def redact(text: str, mark: str = "[secret]", min_cost: float = MIN_COST, words: Words = COMMON) -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    base, added, _ = find(text, min_cost, words)
    out, at = [], 0
    for start, _, end in sorted(base + added):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, words: Words | None = None) -> DataFrame:
    """The documents with their secrets marked; ``text`` and ``n_chars`` change, nothing else.

    Every row stays; a null text stays null (and its ``n_chars`` is null), an empty one empty.
    ``words`` as in :func:`secrets`.
    """
    known = _shared(docs, words)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [None if t is None else redact(t, words=known.value) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(tidy(clean), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
