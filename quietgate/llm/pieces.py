"""SentencePiece encoding by sampling, and lossless decoding.

The lattice of a text has a node at each character and an edge for each piece. Forward
filtering sums the weights of all paths up to a node; backward sampling then draws a path from
the end. Draws are hashes of the row's key and the node, so a row's segmentation is the same in
every run and under every partitioning. Pieces do not cross the start of a word, so the lattice
falls into words, and the forward sums of a word are computed once and kept.

A piece weighs one over its rank (plus ``RANK_OFFSET``) to the power ``theta``: the vocabulary is
one of merges, without probabilities, and frequencies fall about so with the rank.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, remembered, slices, tidy
from .suffixes import _mix

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
RANK_OFFSET = 10
THETA = 1.0
#: Weight of one byte of a character that is no piece by itself.
BYTE_WEIGHT = 1e-5
#: A word of more characters is cut after each so many; pieces do not cross the cut.
LONGEST_WORD = 4096
#: Edges of words whose forward sums a worker remembers, bytes of text sampled together, and
#: characters of words filtered together.
_EDGES, _SLICE, _CELLS = 3_000_000, 1 << 20, 1 << 15
#: Slots of the table of pieces' hashes.
_SLOT_BITS = 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15
#: The first character of a word's key: a blank stands before it, or it goes on after a cut.
_BLANK, _GOES_ON = SPACE, "+"


class Vocabulary:
    """Pieces by the hash of their characters, their weights and their bytes.

    Special pieces and runs of blanks are not used.
    """

    def __init__(self, path: str, theta: float = THETA) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.weight: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.raw.append(piece.replace(SPACE, " ").encode())
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.raw[i] = bytes([value])
                self.byte_ids[value] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.raw[i] = b""
            elif SPACE not in piece[1:]:
                self.weight[piece] = (i, (max(0.0, -model.get_score(i)) + RANK_OFFSET) ** -theta)
        self.longest = max(map(len, self.weight))
        size = LONGEST_WORD + 1
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        hashes = {}
        for piece, (i, weight) in self.weight.items():
            codes = np.array([[ord(c) for c in piece]], np.int64)
            hashes[int(self.stretch(self.prefixes(codes), 0, len(piece))[0])] = (i, weight)
        if len(hashes) < len(self.weight):
            raise ValueError("two pieces have one hash")
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([hashes[h][0] for h in sorted(hashes)], np.int64)
        self.weights = np.array([hashes[h][1] for h in sorted(hashes)])
        slots = np.arange((1 << _SLOT_BITS) + 1, dtype=np.uint64)
        self.slots = np.searchsorted(self.hashes >> np.uint64(64 - _SLOT_BITS), slots)
        self.fullest = int(np.diff(self.slots).max())

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and the piece's number in order of hashes.

        Most are none, and most of those fall into an empty slot.
        """
        slot = (hashed >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        first = self.slots[slot]
        size = self.slots[slot + 1] - first
        some = np.flatnonzero(size)
        found = np.full(len(hashed), -1, np.int64)
        for i in range(self.fullest):
            some = some[size[some] > i]
            equal = some[self.hashes[first[some] + i] == hashed[some]]
            found[equal] = first[equal] + i
        at = np.flatnonzero(found >= 0)
        return at, found[at]

    def prefixes(self, codes: np.ndarray) -> np.ndarray:
        """Prefix hashes of each row of characters."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(_mix((codes + 3).astype(np.uint64)) * self.up[: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def stretch(self, prefixes: np.ndarray, start, end) -> np.ndarray:
        return _mix((prefixes[:, end] - prefixes[:, start]) * self.down[start])

    def decode(self, ids: list[int]) -> str:
        """The text that the pieces spell: exactly the one that was encoded."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


class Column:
    """Numbers that are only ever added at the end; room doubles, so each is moved a few times."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1 << 12, kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, parts: Iterable[np.ndarray]) -> None:
        for part in parts:
            size = self.size + len(part)
            if size > len(self.room):
                room = np.zeros(1 << size.bit_length(), self.room.dtype)
                room[: self.size] = self.all
                self.room = room
            self.room[self.size : size] = part
            self.size = size


class Lattice:
    """Words, and the forward-filtered edges of all of them in flat arrays.

    A node's edges follow each other; ``high`` is the node's number plus the probability that its
    path comes by this edge or one before it, so one binary search draws an edge for any node.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.high, self.back, self.piece = Column(np.float64), Column(np.int64), Column(np.int32)
        self.first, self.last = Column(np.int64), Column(np.int64)  # by word: its nodes

    def learn(self, keys: list[str]) -> None:
        """Forward filtering of new words, those of like length together."""
        keys = sorted(keys, key=len)
        parts: list[tuple[np.ndarray, ...]] = []
        node = int(self.last.all[-1]) + 1 if len(self.last.all) else 0
        at = 0
        while at < len(keys):
            wide = len(keys[at])
            n = max(1, min(len(keys) - at, _CELLS // max(1, wide)))
            while n > 1 and n * len(keys[at + n - 1]) > _CELLS:
                n = max(1, n // 2)
            parts.append(self._filter(keys[at : at + n], node))
            node = int(parts[-1][4][-1]) + 1
            at += n
        for key in keys:
            self.words[key] = len(self.words)
        for column, new in zip((self.high, self.back, self.piece, self.first, self.last), zip(*parts)):
            column.add(new)

    def _filter(self, keys: list[str], node: int) -> tuple[np.ndarray, ...]:
        known = self.vocabulary
        words = [k if k[0] == _BLANK else k[1:] for k in keys]
        n, wide = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        codes = np.full((n, wide), -2, np.int64)
        codes[np.arange(wide) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        match = np.where(codes == ord(SPACE), -1, codes)  # the text's own such sign is no blank
        match[[k[0] == _BLANK for k in keys], 0] = ord(SPACE)
        prefixes = known.prefixes(match)
        most = min(known.longest, wide)
        ids = np.full((n, wide, most), -1, np.int64)  # by word, end and length, each less one
        weights = np.zeros((n, wide, most))
        for length in range(1, most + 1):
            starts = np.arange(wide - length + 1)
            rows, cols = np.nonzero(starts + length <= size[:, None])
            hashed = _mix((prefixes[rows, cols + length] - prefixes[rows, cols]) * known.down[cols])
            hit, found = known.find(hashed)
            ids[rows[hit], cols[hit] + length - 1, length - 1] = known.ids[found]
            weights[rows[hit], cols[hit] + length - 1, length - 1] = known.weights[found]
        rows, cols = np.nonzero((ids[:, :, 0] < 0) & (np.arange(wide) < size[:, None]))
        lone = codes[rows, cols]
        ids[rows, cols, 0] = -2 - lone  # the character's bytes
        weights[rows, cols, 0] = BYTE_WEIGHT ** (1 + (lone > 0x7F) + (lone > 0x7FF) + (lone > 0xFFFF))
        total = np.zeros((n, wide + 1))
        total[:, 0] = 1.0
        upto = np.zeros((n, wide, most))
        for end in range(1, wide + 1):
            reach = min(end, most)
            part = np.cumsum(total[:, end - reach : end][:, ::-1] * weights[:, end - 1, :reach], axis=1)
            whole = part[:, -1]
            total[:, end] = whole
            upto[:, end - 1, :reach] = part / np.where(whole > 0, whole, 1.0)[:, None]
            tiny = (whole < 1e-200) & (whole > 0)
            if tiny.any():  # only the ratios among the last sums matter
                total[tiny, max(0, end - most) : end + 1] *= 1e200
        first = node + np.concatenate(([0], np.cumsum(size)[:-1]))
        rows, ends, lengths = np.nonzero(ids != -1)
        numbers = first[rows] + ends
        cumulative = upto[rows, ends, lengths]
        final = np.append(numbers[1:] != numbers[:-1], True)
        cumulative[final] = 1.0
        start = ends - lengths - 1
        back = np.where(start >= 0, first[rows] + start, -1)
        return numbers + cumulative, back, ids[rows, ends, lengths], first, first + size - 1

    def sample(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts and where each text's start (one more than the texts).

        Backward sampling of all words at once: each round draws one edge of every word that has
        not come to its start.
        """
        if len(self.high.all) > _EDGES:
            self.forget()
        words = [_words(t) for t in texts]
        new = set().union(*words) - self.words.keys()
        if new:
            self.learn(list(new))
        counts = np.array([len(w) for w in words], np.int64)
        number = np.array([self.words[w] for ws in words for w in ws], np.int64)
        high, back, piece = self.high.all, self.back.all, self.piece.all
        first, node = self.first.all[number], self.last.all[number]
        starts = np.concatenate(([0], np.cumsum(counts)))
        place = np.arange(len(number)) - np.repeat(starts[:-1], counts)
        key = np.repeat(_mix(np.array(keys, np.int64).view(np.uint64)), counts)
        seed = _mix(key + place.astype(np.uint64) * _GOLDEN)
        live = np.arange(len(number))
        steps = np.zeros(len(number), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            mixed = _mix(seed[live] + (node - first[live] + 1).astype(np.uint64) * _GOLDEN)
            edge = np.searchsorted(high, node + (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
            drawn.append((live, piece[edge]))
            steps[live] += 1
            node = back[edge]
            live, node = live[node >= 0], node[node >= 0]
        ends = np.cumsum(steps)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for turn, (which, found) in enumerate(drawn):
            out[ends[which] - 1 - turn] = found
        return self._spell(out, np.concatenate(([0], ends))[starts])

    def _spell(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece (below -1) replaced by the pieces of their bytes."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids.astype(np.int32), at
        raws = [chr(-2 - x).encode("utf-8", "surrogatepass") for x in ids[lone].tolist()]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(r) for r in raws]
        ends = np.concatenate(([0], np.cumsum(times)))
        out = np.repeat(ids, times)
        out[out < 0] = self.vocabulary.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
        return out.astype(np.int32), ends[at]


def _words(text: str) -> list[str]:
    if not text:
        return []
    words = [_BLANK + w for w in text.split(" ")]
    if max(map(len, words)) <= LONGEST_WORD:
        return words
    return [
        w[i : i + LONGEST_WORD] if not i else _GOES_ON + w[i : i + LONGEST_WORD]
        for w in words for i in range(0, len(w), LONGEST_WORD)
    ]


#: What a worker keeps between tasks.
_KEPT = ("pieces", "lattice")


def _vocabulary(path: str, theta: float) -> Vocabulary:
    return remembered(("pieces", path, theta), lambda: Vocabulary(path, theta))


def _lattice(path: str, theta: float) -> Lattice:
    return remembered(("lattice", path, theta), lambda: Lattice(_vocabulary(path, theta)))


def _path(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def _encoder(where: str, theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _lattice(where, theta)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                ids, at = known.sample(part.column("text").to_pylist(), part.column("key").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), lists], names=["doc_id", "text", "ids"]
                )

    return run


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("key"),
    )


def encode(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 0) -> DataFrame:
    """``doc_id, text, ids``: each text (a null one is empty) and its sampled pieces.

    The key of a row is its id and ``seed``: rows of equal id and text get equal pieces, equal
    texts of other ids other ones; a null id has a key of its own. One narrow stage.
    """
    run = _encoder(_path(path), theta)
    return _keyed(docs, seed).mapInArrow(tidy(run, *_KEPT), "doc_id long, text string, ids array<int>")


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()),
     ("decoded_sha256", pa.string()), ("lossless", pa.bool_())]
)


_DIGEST_COLUMNS = "doc_id long, n_chars long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def _digester(where: str, theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(where, theta)
        for batch in batches:
            rows = []
            for doc, text, ids in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ids")):
                numbers = ids.values.to_numpy()
                back, text = known.decode(numbers.tolist()), text.as_py()
                rows.append((doc, len(text), len(numbers), zlib.crc32(numbers.astype("<u4").tobytes()),
                             hashlib.sha256(back.encode()).hexdigest(), back == text))
            if rows:
                yield record(_DIGEST, zip(*rows))

    return run


def digest(encoded: DataFrame, path: str | None = None, theta: float = THETA) -> DataFrame:
    """``doc_id, n_chars, n_pieces, ids_crc32, decoded_sha256, lossless`` of encoded rows.

    The pieces alone are decoded; ``lossless`` says whether that gave the text again. A text
    without pieces is the empty one; a null id stays null, repeated rows are answered each.
    """
    return encoded.mapInArrow(tidy(_digester(_path(path), theta), *_KEPT), _DIGEST_COLUMNS)


def encoded_digest(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = 0) -> DataFrame:
    """:func:`digest` of :func:`encode` in one Python stage: pieces do not leave it."""
    encoded, told = _encoder(_path(path), theta), _digester(_path(path), theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from told(encoded(batches))

    return _keyed(docs, seed).mapInArrow(tidy(run, *_KEPT), _DIGEST_COLUMNS)
