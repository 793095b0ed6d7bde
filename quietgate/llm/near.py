"""Near duplicates by BagMinHash signatures over the multiset of five-word shingles.

A shingle of weight w (its count) takes part in Poisson processes over the weights 0 .. w: one
for each interval [0, 1), [1, 2), [2, 4), [4, 8) ... below w, of a rate as wide as the interval,
whose points beyond w are thinned out. Every point falls into one of ``COMPONENTS`` components;
a component's signature is its earliest point. Two texts share it with the probability of their
weighted Jaccard similarity. Signatures are cut into bands; texts that share a band are
compared by the overlap of their multisets.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .common import in_bloom, long_bloom, record, remembered, slices, stored, tidy
from .suffixes import _mix, _polynomials

SHINGLE = 5
SIMILARITY = 0.8
#: 25 bands of 5: of pairs at 0.8, five in 100,000 share no band.
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Bytes of text sketched together.
_SLICE = 1 << 18
#: So many times the rows of a bucket are compared with one centre; what then is not in one
#: component meets by its rarest differences from a centre.
_STAR_ROUNDS = 5

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) & (1 << 64) - 1)


def _fold() -> np.ndarray:
    """ASCII letters, digits and bytes of other characters belong to words, all else does not.

    For texts that :func:`parted` has gone over."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
        table[ord(first) : ord(last) + 1] = True
    return table


_WORD = _fold()

#: Scripts written without blanks between words: Thai, Lao, Myanmar, Khmer, Tai, kana, Bopomofo,
#: Han, Yi, Javanese. Each letter, with its marks, is a word.
_NO_BLANKS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007),
    (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3041, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)


#: Kinds of characters outside ASCII: of words, no part of a text, parting words, words by themselves.
_OF_WORDS, _FORMAT, _APART, _SINGLE = range(4)


def _kinds() -> tuple[np.ndarray, re.Pattern]:
    """The kind of each code point, and a pattern of the letters that are words, with their marks."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    marks, single = [], []
    for code in range(0x80, sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind == "Cf" and code != 0x200B:
            kinds[code] = _FORMAT
        elif kind[0] == "M":
            marks.append(code)
        elif kind[0] not in "LN" and kind not in ("Cn", "Co", "Cs"):
            kinds[code] = _APART
        elif kind[0] in "LN" and any(a <= code <= b for a, b in _NO_BLANKS):
            kinds[code] = _SINGLE
            single.append(code)

    def listed(codes: list[int]) -> str:
        ends = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1]
        runs = zip([0, *ends], [*ends, len(codes)])
        return "[%s]" % "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in runs)

    return kinds, re.compile(f"{listed(single)}{listed(marks)}*+")


def parted(value: str) -> str:
    """The text in lower case with blanks for the separators outside ASCII, so that bytes tell words.

    Letters of scripts without blanks stand alone; characters that only format are left out.
    """
    value = value.lower()
    if value.isascii():
        return value
    kinds, single = remembered("near words", _kinds)
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[codes]
    if not kind.any():
        return value
    codes = np.where(kind == _APART, np.uint32(0x20), codes)[kind != _FORMAT]
    value = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return single.sub(r" \g<0> ", value) if (kind == _SINGLE).any() else value


def shingles(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of some texts as a multiset: text, shingle's hash and weight, by text.

    Words are runs of ASCII letters and digits and of other characters, lower-cased. A text of
    one to four words has one shingle of them all; one without words has none.
    """
    raws = [parted(v).encode("utf-8", "replace") for v in values]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raws])
    hash_, _ = _polynomials_for(len(data))
    prefixes = hash_.prefixes(data)
    inside = np.concatenate(([False], _WORD[data], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    words = hash_.stretch(prefixes, starts, ends)
    doc = np.searchsorted(ends_of, starts, side="right")
    n = np.bincount(doc, minlength=len(values))
    size = SHINGLE
    hashed = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size if len(hashed) else 0):
        hashed = _mix(hashed * _GOLDEN + words[j : j + len(hashed)])
    whole = doc[: len(hashed)] == doc[size - 1 :] if len(hashed) else np.zeros(0, bool)
    at, found = doc[: len(hashed)][whole], hashed[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.searchsorted(doc, short)
        sums = []
        for d, f in zip(short, first):
            h = np.zeros(1, np.uint64)
            for w in words[f : f + n[d]]:
                h = _mix(h * _GOLDEN + w)
            sums.append(h[0] ^ np.uint64(n[d]))
        at, found = np.concatenate((at, short)), np.concatenate((found, np.array(sums, np.uint64)))
    order = np.lexsort((found, at))
    at, found = at[order], found[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (found[1:] != found[:-1])
    begin = np.flatnonzero(new)
    return at[begin], found[begin], np.diff(np.append(begin, len(at)))


def _polynomials_for(size: int):
    one, two = _polynomials()
    if size <= len(one.up):
        return one, two
    from .suffixes import _BASES, Polynomial

    return tuple(Polynomial(b, size) for b in _BASES)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashed longs."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n by COMPONENTS) of multisets; rows of texts without elements stay infinite.

    All points before a time are drawn, text by text as many as fill the components with high
    probability; texts with a component still open are drawn again up to twice that time.
    """
    m = COMPONENTS
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, weights, minlength=n)
    horizon = m * (np.log(m) + 3.0) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        d, e, w = doc[use], elements[use], weights[use].astype(np.float64)
        sign = np.full(n * m, np.inf)
        low, width, octave = 0.0, 1.0, 0
        while len(d):
            seed = _mix(e + _step(octave))
            clock, rest, text, over = np.zeros(len(d)), w - low, d, seed
            k = 0
            while len(text):
                drawn = _mix(over + _step(3 * k + 1))
                clock = clock - np.log(_unit(drawn)) / width
                live = clock <= horizon[text]
                clock, rest, text, over = clock[live], rest[live], text[live], over[live]
                place = _unit(_mix(over + _step(3 * k + 2))) * width
                part = (_mix(over + _step(3 * k + 3)) % np.uint64(m)).astype(np.int64)
                kept = place < rest
                np.minimum.at(sign, text[kept] * m + part[kept], clock[kept])
                k += 1
            low, width, octave = low + width, max(1.0, low + width), octave + 1
            more = w > low
            d, e, w = d[more], e[more], w[more]
        found = sign.reshape(n, m)
        done = todo & np.isfinite(found).all(axis=1)
        out[done] = found[done]
        todo &= ~done
        horizon[todo] *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(signature), 1))
    for j in range(ROWS):
        out = _mix(out * _GOLDEN + bits[:, :, j])
    return out.view(np.int64)


def occurrences(value: str) -> np.ndarray:
    """A text's multiset as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    _, found, weights = shingles([value])
    repeated = np.repeat(found, weights)
    number = np.arange(len(repeated)) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.sort(_mix(repeated + number.astype(np.uint64) * _GOLDEN))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of occurrences; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_SKETCH = [("id", pa.int64()), ("key", pa.string()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_SKETCH)
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            values = part.column("text").to_pylist()
            doc, found, weights = shingles(values)
            n = np.bincount(doc, weights, minlength=len(values)).astype(np.int32)
            hashed = bands(bag_min_hash(doc, found, weights, len(values)))
            lists = [h if k else None for h, k in zip(hashed, n)]
            yield record(schema, (part.column("id"), part.column("key"), n, lists))


def _keyed(docs: DataFrame) -> DataFrame:
    """``id`` (a null one the lowest), ``key`` (the text's digest) and ``text``."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select("id", F.md5("text").alias("key"), "text")


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("occ", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            found = [occurrences(text.as_py()).tobytes() for text in part.column("text")]
            yield record(schema, (part.column("row"), found))


def _occurrences(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("a", "b")]
        for a, b, oa, ob in zip(*columns, batch.column("oa"), batch.column("ob")):
            if overlap(_occurrences(oa), _occurrences(ob)) >= SIMILARITY - 1e-12:
                out.append((a, b))
        if out:
            yield record(schema, zip(*out))


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of the pairs (each once), those whose texts are similar enough. Few multisets, large or
    not, stand in a task at a time: pairs stream through."""
    b = known.select(F.col("row").alias("b"), F.col("occ").alias("ob"))
    a = known.select(F.col("row").alias("a"), F.col("occ").alias("oa"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "oa", "ob").mapInArrow(tidy(_compare), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``row, label``: each row of an edge and the least row it is connected with.

    Large-star and small-star steps by turns, each of two joins that shrink by a minimum before
    they are shuffled; rounds grow with the logarithm of a component's longest chain.
    """
    def star(graph: DataFrame, large: bool) -> DataFrame:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else graph.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = both.join(least, "a")
        if large:
            out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.select("a", F.col("m").alias("b"))
            )
        return out.filter("a <> b").distinct()

    graph = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        graph = cut(star(star(graph, True), False))
        now = tuple(graph.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = graph.select(F.col("a").alias("row"), F.col("b").alias("label"))
    return cut(stars.unionByName(stars.select(F.col("label").alias("row"), "label").distinct()))


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's difference to its centre, and how many of its elements may be the first that it
    shares with another row (see :func:`_differing_pairs`)."""
    schema = pa.schema(
        [("c", pa.int64()), ("row", pa.int64()), ("comp", pa.int64()), ("n", pa.int32()), ("star", pa.bool_()),
         ("inside", pa.bool_()), ("short", pa.int32()), ("long", pa.int32()), ("elements", pa.list_(pa.int64()))]
    )
    share = (1 - SIMILARITY) / (1 + SIMILARITY)
    for batch in batches:
        out, held = [], 0
        columns = [batch.column(c).to_pylist() for c in ("c", "cc", "row", "comp")]
        for c, cc, row, comp, occ, centre in zip(*columns, batch.column("occ"), batch.column("oc")):
            mine, other = _occurrences(occ), _occurrences(centre)
            apart = np.setxor1d(mine, other, assume_unique=True)
            d, n, nc = len(apart), len(mine), len(other)
            star = d <= share * (n + nc) + 1e-9
            excess = d - share * n
            # With a row outside, whose excess is above share * nc, and with any, none being below -share * nc.
            short = d + 1 - int(np.ceil((excess + share * nc) / 2 + 1e-9))
            long = d + 1 - max(1, int(np.ceil((excess - share * nc) / 2 - 1e-9)))
            out.append((c, row, comp, n, star, star or comp == cc, short, long, apart.view(np.int64)))
            held += d
            if held > _SLICE:
                yield record(schema, zip(*out))
                out, held = [], 0
        if out:
            yield record(schema, zip(*out))


def _differing_pairs(open_: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of rows with the centres of their buckets, and pairs ``a, b`` of rows of one
    bucket in different components that may be similar enough: all that are.

    With D a row's symmetric difference to a centre they share, two rows are similar enough if
    and only if their excesses ``|D| - n / 9`` (for a similarity of 0.8) add up to at most twice
    what their Ds have in common. Rows linked with the centre or in its component are inside and
    pair nothing among themselves. One of a pair is outside, its excess is above a ninth of the
    centre's n, so the Ds have in common more than half of an inside row's: what a group of
    copies shares is in no D, and of what they do not share each one's own edits come first in
    the order by rarity. Elements of no row outside pair nothing and stand before all others.
    """
    own = open_.select("band", F.col("row").alias("c"), F.col("comp").alias("cc"))
    centres = _first_centres(open_).drop("cc").join(own, ["band", "c"])
    met = open_.join(centres, "band").select("row", "comp", "c", "cc").distinct()
    centre = known.select(F.col("row").alias("c"), F.col("occ").alias("oc"))
    schema = (
        "c long, row long, comp long, n int, star boolean, inside boolean, short int, long int, elements array<bigint>"
    )
    apart = stored(met.join(known, "row").join(centre, "c").select("c", "cc", "row", "comp", "occ", "oc").mapInArrow(tidy(_differences), schema))
    stars = apart.filter("star and row <> c").select(F.least("row", "c").alias("a"), F.greatest("row", "c").alias("b"))
    each = apart.select("c", "row", "comp", "inside", F.explode("elements").alias("element"))
    useful = each.groupBy("c", "element").agg(
        F.count(F.lit(1)).alias("often"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("inside").alias("inside")
    ).filter("x <> y and not inside").select("c", "element", "often")
    by = each.select("c", "row", "element").join(useful, ["c", "element"]).groupBy("c", "row").agg(
        F.array_sort(F.collect_list(F.struct("often", "element"))).alias("by")  # a text's own
    )
    told = apart.withColumn("size", F.size("elements")).drop("elements", "star")
    first = told.join(by, ["c", "row"]).withColumn("alone", F.col("size") - F.size("by"))
    most = F.when(F.col("inside"), F.col("short")).otherwise(F.col("long")) - F.col("alone")
    prefix = first.withColumn("most", most).filter("most > 0").select(
        "c", "row", "comp", "n", "inside", "short", "alone", F.posexplode(F.slice("by", F.lit(1), F.col("most"))).alias("at", "e")
    ).select(
        "c", "row", "comp", "n", "inside", F.col("e.element").alias("element"),
        (F.col("at") + F.col("alone") < F.col("short")).alias("few"),
    )
    prefix = stored(prefix)
    outside = prefix.filter("not inside").select(
        "c", "element", F.col("row").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), "few"
    )
    alike = (F.col("ca") != F.col("cb")) & (
        F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(SIMILARITY) - 1e-9
    )

    def paired(rows: DataFrame, others: DataFrame, which: Column) -> DataFrame:
        rows = rows.select("c", "element", F.col("row").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
        return rows.join(others.drop("few"), ["c", "element"]).filter(alike & which).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        )

    mixed = paired(prefix.filter("inside"), outside, F.lit(True))
    both = paired(prefix.filter("not inside and few"), outside.filter("few"), F.col("a") < F.col("b"))
    return stars.distinct(), mixed.unionByName(both).distinct()


def _first_centres(open_: DataFrame) -> DataFrame:
    """``band, c, cc``: of each bucket the row with the most companions in all its buckets.

    Copies that differ from each other more than from what they were copied from meet it in
    their largest buckets, and it is in all of those.
    """
    sizes = open_.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    weight = open_.select("band", "row").join(sizes, "band").groupBy("row").agg(F.sum("k").alias("weight"))
    rows = open_.select("band", "row").join(weight, "row")
    best = rows.groupBy("band").agg(F.max(F.struct("weight", (-F.col("row")).alias("least"))).alias("best"))
    return best.select("band", (-F.col("best.least")).alias("c"), (-F.col("best.least")).alias("cc"))


def _drawn_centres(open_: DataFrame, turn: int) -> DataFrame:
    """``band, c, cc``: of each bucket's largest component one row, drawn anew each turn.

    What is left of a group of copies meets as many others of it as it has buckets, each turn.
    """
    drawn = F.struct(F.xxhash64("row", F.lit(turn)).alias("draw"), "row")
    each = open_.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("drawn"))
    best = each.groupBy("band").agg(F.max(F.struct("n", "comp", F.col("drawn.row").alias("c"))).alias("best"))
    return best.select("band", "best.c", F.col("best.comp").alias("cc"))


def _joined_components(label: DataFrame | None, new: DataFrame) -> DataFrame:
    """``row, label`` after new links: those between what is already one component are left out."""
    if label is None:
        return components(new)
    a, b = (label.select(F.col("row").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    between = new.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")
    ).filter("a <> b")
    between = cut(between.distinct())
    if between.isEmpty():
        return label
    merged = components(between)
    after = merged.select(F.col("row").alias("label"), F.col("label").alias("least"))
    old = label.join(after, "label", "left").select("row", F.coalesce("least", "label").alias("label"))
    return cut(old.unionByName(merged.join(label, "row", "left_anti").select("row", "label")))


def classes(docs: DataFrame) -> DataFrame:
    """``row, id, key, n, rep, label`` of every row: its text's first row and its class' first.

    Equal texts are one text; different ones are linked if they share a band and their
    similarity is ``SIMILARITY`` or more, and classes are the components of the links. In each
    bucket texts are compared with one centre; where a bucket still holds several components
    another centre is taken; at last the rows of such buckets meet by what they rarely differ in
    from their bucket's centre, which loses no link between components. Pairs already known to be
    in one component are not compared.
    """
    schema = "id long, key string, n int, bands array<bigint>"
    keyed = _keyed(docs)
    sketch = stored(keyed.mapInArrow(tidy(_sketch, "near words", "polynomials"), schema).withColumn("row", F.monotonically_increasing_id()))
    reps = sketch.groupBy("key").agg(F.min("row").alias("rep"))
    members = stored(sketch.select("row", "id", "key", "n").join(reps, "key"))
    firsts = members.filter("row = rep").select("row")
    entries = sketch.select("row", F.explode("bands").alias("band")).join(firsts, "row", "left_semi")
    shared = entries.groupBy("band").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high")
    buckets = stored(entries.join(shared.select("band"), "band"))
    involved = stored(
        members.join(buckets.select("row").distinct(), "row", "left_semi").select(
            "row", "id", "key", F.xxhash64("key").alias("hash")
        )
    )
    wanted = docs.sparkSession.sparkContext.broadcast(long_bloom(involved, "hash"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(wanted.value, batch.column("hash").to_numpy())))

    rows = keyed.withColumn("hash", F.xxhash64("key"))
    known = stored(
        rows.mapInArrow(tidy(asked), rows.schema).join(involved.select("row", "id", "key"), ["id", "key"])
        .select("row", "text").mapInArrow(tidy(_multisets, "near words", "polynomials"), "row long, occ binary")
    )
    if members.filter("row <> rep").join(involved.select("id", "key"), ["id", "key"], "left_semi").limit(1).count():
        known = stored(known.groupBy("row").agg(F.first("occ").alias("occ")))  # rows that repeat in id and text

    tested = label = None
    open_ = buckets.withColumn("comp", F.col("row"))
    for turn in range(_STAR_ROUNDS + 1):
        last = False
        if turn:
            told = open_.drop("comp")
            if label is not None:
                told = told.join(label, "row", "left").withColumn("comp", F.coalesce("label", "row")).drop("label")
            else:
                told = told.withColumn("comp", F.col("row"))
            several = told.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
            open_ = stored(told.join(several.select("band"), "band").select("row", "band", "comp"))
            if open_.isEmpty():
                break
            last = turn == _STAR_ROUNDS
        stars = None
        if last:
            stars, pairs = _differing_pairs(open_, known)
        else:
            centres = _drawn_centres(open_, turn) if turn else _first_centres(open_)
            met = open_.join(centres, "band").filter("comp <> cc")
            pairs = met.select(F.least("row", "c").alias("a"), F.greatest("row", "c").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        new = _verified(pairs, known)
        new = stored(new if stars is None else new.unionByName(stars).distinct())
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not new.isEmpty():
            label = _joined_components(label, new)
        if last:
            break
    out = members
    if label is None:
        return out.withColumn("label", F.col("rep"))
    joined = out.join(label.withColumnRenamed("row", "rep"), "rep", "left")
    return joined.withColumn("label", F.coalesce("label", "rep")).select("row", "id", "key", "n", "rep", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size, n_shingles, kept`` of every row.

    A class is named by its least ``doc_id`` (null ids are the lowest, and stay null); one row
    of each class is kept: that of the least id. Null and empty texts are equal texts, and so a
    class of their own; rows that repeat are in one class. Texts without words are only ever
    equal, never similar.
    """
    found = stored(classes(docs))
    by = found.groupBy("label").agg(
        F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size")
    )
    null = lambda c: F.when(c != -(1 << 63), c)
    return found.join(by, "label").select(
        null(F.col("id")).alias("doc_id"), null(F.col("first.id")).alias("class_id"), "class_size",
        F.col("n").cast("long").alias("n_shingles"), (F.col("row") == F.col("first.row")).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: that of the least id. Columns and values stay as they are.

    Documents that are surely alone are not shuffled.
    """
    found = stored(classes(docs))
    first = found.groupBy("label").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    told = found.join(first.filter("size > 1"), "label").groupBy("id", "key").agg(
        F.max((F.col("row") == F.col("first.row")).cast("int")).alias("keep")
    )
    told = stored(told.withColumn("hash", F.xxhash64("key")))
    touched = docs.sparkSession.sparkContext.broadcast(long_bloom(told, "hash"))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.md5(F.coalesce("text", F.lit(""))).alias("key"),
        F.struct(*docs.columns).alias("row"),
    ).withColumn("hash", F.xxhash64("key"))

    def part(inside: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = in_bloom(touched.value, batch.column("hash").to_numpy())
                yield batch.filter(pa.array(hit == inside))

        return run

    clear = rows.mapInArrow(tidy(part(False)), rows.schema).select("row")
    asked = rows.mapInArrow(tidy(part(True)), rows.schema).join(told.select("id", "key", "keep"), ["id", "key"], "left")
    alone = asked.filter("keep is null").select("row")
    kept = asked.filter("keep = 1").groupBy("id", "key").agg(F.first("row").alias("row")).select("row")
    out = clear.unionByName(alone).unionByName(kept)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
