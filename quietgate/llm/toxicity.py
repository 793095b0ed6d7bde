"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers (reported speech, negation, targets, insults, threats) are composed into
one automaton that reads a text's words and marks once. The first three mark what they read for
the last two; insults are a lexicon learned from labels, words and word beginnings. What is
written (an insult plain, negated or reported, with a target on either side, a threat against a
target on either side) is summed and maximised over clauses; a logistic model learned from labels
turns that into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import record, texts

#: The classifier is fitted on so many labelled rows at most, those with the least id hashes.
LABELLED_ROWS = 40_000
#: A lexicon entry must occur in so many different toxic texts, and its odds of being in a
#: toxic text be so many times those of being in another; the dearest entries are kept.
LEAST_TOXIC, LEAST_ODDS, LEXICON = 5, 12.0, 4_000
#: Lengths of word beginnings that may enter the lexicon.
STEMS = (4, 5, 6, 7)

# The closed classes of the grammar in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u ur he him she they them their these those people everyone "
    "du dich dir dein deine ihr euch euer sie leute tu toi te ton vous votre ils elles gens "
    "tú ti usted ustedes vosotros ellos ellas gente".split()
)
THREATS = frozenset(
    "kill hurt beat destroy shoot stab burn hang murder punch strangle töten umbringen schlagen "
    "verprügeln erschießen tuer frapper brûler détruire massacrer matar golpear quemar destruir".split()
)
NEGATIONS = frozenset(
    "not no never none cannot without dont cant wont isnt nicht kein keine nie niemals ohne "
    "pas jamais aucun sans nunca jamás ningún ninguna sin".split()
)
REPORTS = frozenset(
    "said says say wrote writes quoted quotes claimed claims reported reports called sagte sagt "
    "schrieb behauptet dit disait écrit affirme dijo dice escribió afirma".split()
)

#: Words (with their negating clitic) and the marks that end or open something.
_TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[.!?;:,|\n\"“”„«»]")
#: What a threat against a target weighs among insults.
_THREAT_WORTH = 3.0
#: Words whose class a worker remembers.
_REMEMBERED = 500_000

LINE, STOP, PAUSE, QUOTE, PLAIN, TARGET, THREAT, NEGATION, REPORT, INSULT = range(10)
#: Line ends, ends of sentences, pauses within one, and marks of quotation.
_MARKS = {"\n": LINE, "|": LINE} | dict.fromkeys(".!?;", STOP) | dict.fromkeys(",:", PAUSE) | dict.fromkeys('"“”„«»', QUOTE)
#: How many words a negation, a target on either side of an insult, and a threat reach.
_NEGATED, _AIMED, _THREATENED = 3, 5, 3

FEATURES = (
    "insult", "insult_at_target", "negated", "reported", "threat", "dearest_clause",
    "matched_clauses", "insults", "bias",
)


def speech(state: tuple[int, int], kind: int) -> tuple[int, int]:
    """Whether speech is reported, and the quotation: 0 none, 1 somebody's own, 2 a reported one.

    A report holds through colons and commas to the end of its sentence; a quotation that it
    opens holds through sentences to its closing mark. A line ends everything.
    """
    reported, quote = state
    if kind == LINE:
        return 0, 0
    if kind == QUOTE:
        return (0, 0) if quote else (0, 2 if reported else 1)
    if kind == STOP:
        return 0, quote
    return int(quote != 2 and (reported or kind == REPORT)), quote


def _window(ends: tuple[int, ...], opener: int, reach: int):
    """A transducer that holds for ``reach`` words after its opener, unless it is ended before."""
    def move(left: int, kind: int) -> int:
        if kind in ends:
            return 0
        if kind <= QUOTE:
            return left  # no word
        return reach if kind == opener else max(0, left - 1)

    return move


negation = _window((LINE, STOP, PAUSE), NEGATION, _NEGATED)
target = _window((LINE, STOP), TARGET, _AIMED)
_waiting = _window((LINE, STOP, PAUSE), -1, 0)


def insult(waiting: int, kind: int, reported: bool, negated: bool, aimed: bool) -> tuple[int, int]:
    """Words for which a plain insult still waits for its target, and the output: 0 nothing, 1
    plain, 2 at a target, 3 negated, 4 reported, 5 the insult before was at this target."""
    if kind == INSULT:
        out = 4 if reported else 3 if negated else 2 if aimed else 1
        return _AIMED if out == 1 else 0, out
    if kind == TARGET and waiting:
        return 0, 5
    return _waiting(waiting, kind), 0


def threat(waiting: int, kind: int, reported: bool, negated: bool, aimed: bool) -> tuple[int, bool]:
    """Words for which a threat still waits for its target, and whether a target is threatened."""
    if kind == THREAT:
        free = not reported and not negated
        return _THREATENED if free and not aimed else 0, free and aimed
    if kind == TARGET and waiting:
        return 0, True
    return _waiting(waiting, kind), False


State = tuple[int, int, int, int, int, int]


def step(state: State, kind: int) -> tuple[State, int]:
    """One arc of the composed automaton: next state, and output (an insult's, 8 more at a threat)."""
    reported, quote, negated, aimed, insulted, threatened = state
    marks = (bool(reported or quote == 2), bool(negated), bool(aimed))
    heard = STOP if kind == QUOTE and quote else kind  # nothing reaches out of a quotation
    insulted, said = insult(insulted, heard, *marks)
    threatened, danger = threat(threatened, heard, *marks)
    return (
        *speech((reported, quote), kind), negation(negated, heard), target(aimed, heard), insulted, threatened
    ), said + 8 * danger


def _automaton() -> tuple[list[list[int]], list[list[int]]]:
    """Tables of next states and outputs of the composition; state 0 is a line's start."""
    states: dict[State, int] = {(0, 0, 0, 0, 0, 0): 0}
    todo = list(states)
    moves: list[list[int]] = []
    outs: list[list[int]] = []
    for state in todo:  # grows while it is read
        row, out = [], []
        for kind in range(10):
            following, said = step(state, kind)
            if following not in states:
                states[following] = len(states)
                todo.append(following)
            row.append(states[following])
            out.append(said)
        moves.append(row)
        outs.append(out)
    return moves, outs


MOVES, OUTS = _automaton()


class Tagger(dict):
    """Class and weight of a word: the dearest of the word's own entry and its beginnings'."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        if not word[0].isalpha():
            found = (_MARKS[word], 0.0)
        else:
            stems = [self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n]
            weight = max([self.lexicon.get(word, 0.0), *stems])
            found = (
                (INSULT, weight) if weight > 0
                else (NEGATION, 0.0) if word in NEGATIONS or word.endswith(("n't", "n’t"))
                else (REPORT, 0.0) if word in REPORTS
                else (THREAT, 0.0) if word in THREATS
                else (TARGET, 0.0) if word in TARGETS
                else (PLAIN, 0.0)
            )
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = found
        return found


def features(text: str, tags: Tagger) -> list[float]:
    """What the grammar finds in a text's clauses, as :data:`FEATURES`; an empty text has 0s."""
    sums = [0.0] * 6  # by an insult's output; the last are threats
    dearest, matched, insults = 0.0, 0, 0
    tagged = list(map(tags.__getitem__, _TOKEN.findall(text.lower())))
    if any(k == INSULT or k == THREAT for k, _ in tagged):
        state, clause, hit, last = 0, 0.0, False, 0.0
        for kind, weight in [*tagged, (LINE, 0.0)]:
            out = OUTS[state][kind]
            state = MOVES[state][kind]
            if out:
                hit = True
                if out & 8:
                    sums[5] += _THREAT_WORTH
                    clause += _THREAT_WORTH
                said = out & 7
                if said == 5:  # the plain insult before finds its target
                    sums[1] -= last
                    sums[2] += last
                elif said:
                    sums[said] += weight
                    if said < 3:
                        last = weight
                        insults += 1
                        clause += weight
            if kind <= PAUSE:
                dearest, matched = max(dearest, clause), matched + hit
                clause, hit = 0.0, False
    short = lambda x: float(np.log1p(max(0.0, x)))
    return [
        short(sums[1]), short(sums[2]), short(sums[3]), short(sums[4]), short(sums[5]),
        short(dearest), short(matched), short(insults), 1.0,
    ]


@dataclass
class Grammar:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def score(self, rows: list[list[float]]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(np.array(rows) @ self.weights, -30, 30)))


def _entries(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w[0].isalpha()}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    held: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for entry in _entries(text.as_py()):
                held.setdefault(entry, [0, 0])[0 if toxic else 1] += 1
            if len(held) > 200_000:
                yield record(schema, (list(held), *zip(*held.values())))
                held = {}
    if held:
        yield record(schema, (list(held), *zip(*held.values())))


def _newton(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression with a penalty on the weights, which keeps those of a separable sample finite.

    A step that would raise the loss, as a whole Newton step may, is halved until it lowers it.
    """
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + penalty / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(x.shape[1])
        move = np.linalg.solve(hessian, gradient)
        share, slope = 1.0, float(gradient @ move)
        while share > 1e-6 and not loss(w - share * move) <= now - 1e-4 * share * slope:
            share /= 2
        if share <= 1e-6:
            break  # at the least loss, as far as doubles tell
        w -= share * move
        now = loss(w)
        if np.abs(share * move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Grammar:
    """Learn from at most ``rows`` labelled documents (``labels``: ``doc_id, toxic``).

    Null ids and null labels teach nothing; of a document labelled twice the higher label holds.
    Texts that repeat count once for each label. The sample's ids and labels, bounded by
    ``rows``, are broadcast, so no text of the corpus is shuffled; the lexicon (``LEXICON``
    entries at most) and the sample's features (a few numbers a row) reach the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    taught = texts(docs).join(F.broadcast(cut(sample)), "doc_id")
    stored = cut(taught.select("text", "toxic").withColumn("_key", F.xxhash64("text")))
    once = stored.groupBy("_key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return Grammar()
    counted = once.mapInArrow(_occurrences, "entry string, toxic long, other long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("other") + 0.5) / (n_other + 1))
    dear = counted.filter(F.col("toxic") >= LEAST_TOXIC).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    best = dear.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "entry").limit(LEXICON)
    grammar = Grammar({r["entry"]: float(np.log(r["odds"])) for r in best.collect()})
    found = _with_features(once, grammar).select("toxic", "features").toArrow()
    x = np.array(found["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    grammar.weights = _newton(x, found["toxic"].to_numpy().astype(float))
    return grammar


def _with_features(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns but ``text``, and ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar.lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = Tagger(shared.value)
        for batch in batches:
            found = [features(t.as_py(), tags) for t in batch.column("text")]
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(found, pa.list_(pa.float64()))],
                names=[*[batch.schema.names[i] for i in keep], "features"],
            )

    kept = rows.drop("text")
    return rows.mapInArrow(run, kept.withColumn("features", F.array(F.lit(0.0))).schema)


def score(docs: DataFrame, grammar: Grammar, *columns: str) -> DataFrame:
    """``doc_id``, the named columns, ``score`` and ``predicted`` of every document.

    A null or empty text matches nothing and gets the score of such a text; repeated rows are
    answered once each; without labels of both kinds every score is 0. One narrow stage.
    """
    shared = docs.sparkSession.sparkContext.broadcast((grammar.lexicon, grammar.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Grammar(*shared.value)
        tags = Tagger(known.lexicon)
        for batch in batches:
            found = known.score([features(t.as_py(), tags) for t in batch.column("text")])
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=[*[batch.schema.names[i] for i in keep], "score", "predicted"],
            )

    rows = texts(docs, *columns)
    kept = rows.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return rows.mapInArrow(run, kept.schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
