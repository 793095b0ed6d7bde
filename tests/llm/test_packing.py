import zlib
from array import array
from collections import Counter, defaultdict
import random

import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quietgate.llm import packing

from .rows import awkward, frame

PATH = public_tokenizers.path(packing.TOKENIZER)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    encode = packing.Encoder(PATH)
    rng = random.Random(2)
    letters = "abAB zé ß_-'s't 12²½ \t\n'lł|<>.!?́İΣς字 ａ\x1c\x85\xa0€ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["<|endoftext|> a", "x<|STARTOFTEXT|>", "don't we'll_a-_b", "", None or ""]
    for t in texts:
        assert encode(t) == array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes(), t


def test_remembered_words_are_forgotten_in_turn(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 3)
    encode = packing.Encoder(PATH)
    for text in ("one two three four five", "one two six seven", "five one"):
        assert encode(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert len(encode.words) <= 3


def test_remembered_words_hold_little_memory(tokenizer):
    encode = packing.Encoder(PATH)
    for i in range(60):
        text = " ".join(f"{i:x}{'abcdefghijklmnop'[j % 16]}{j:x}" if j % 2 else "w" + "abcdefghij"[i % 10] * (i // 10) + str(j) for j in range(5000))
        assert encode(text) == array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    held = sum(len(g) for g in (encode.words, encode.words.older))
    assert held <= 200_000


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_fills_well(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20), rng.randint(30, 64)]) for _ in range(4000))
    patterns = packing.plan(counts, 64)
    used = Counter()
    for parts, times in patterns:
        assert sum(parts) <= 64 and times > 0
        for p in parts:
            used[p] += times
    assert used == counts
    least = max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32))
    assert sum(t for _, t in patterns) <= 1.02 * least + 1


def test_plan_finds_exact_complements():
    assert packing.plan({40: 1, 30: 1, 20: 1, 10: 1, 4: 1}, 64) == [([40, 20, 4], 1), ([30, 10], 1)]
    assert packing.plan({32: 4}, 64) == [([32, 32], 2)]
    assert packing.plan({64: 10**12, 1: 64 * 10**9}, 64)[0] == ([64], 10**12)
    assert packing.plan({}, 64) == []


def check(rows, got, tokenizer, capacity):
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for doc in {r[0] for r in rows}:
        mine = sorted(by[doc], key=lambda r: (r.piece, r.ids_crc32))
        want = []
        for d, text, *_ in rows:
            if d == doc:
                ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    want.append((k // capacity, k, len(part), zlib.crc32(array("I", part).tobytes())))
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in mine] == sorted(want, key=lambda x: (x[0], x[3]))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("clash", [False, True])
def test_pieces_and_places(spark, tokenizer, clash):
    rows = awkward()
    got = packing.pack(frame(spark, rows, clash), capacity=64).collect()
    n = check(rows, got, tokenizer, 64)
    assert n <= -(-sum(r.length for r in got) // 64) + 2


def test_one_length_over_many_chunks(spark, tokenizer):
    rows = [(i, "a b c", "en", "a", 5) for i in range(500)]
    got = packing.pack(frame(spark, rows), capacity=8, chunks=7).collect()
    assert check(rows, got, tokenizer, 8) == 250


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).collect() == []


def test_many_texts_look_a_word_up_once(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 50)
    encode = packing.Encoder(PATH)
    rng = random.Random(5)
    plain = [chr(c) for c in range(0x250) if not packing._ODD.search(chr(c))]
    texts = [f"a{c}b {c} {c}{c}x. 's{c}t {c}'ll {c}." for c in plain]
    texts += ["".join(rng.choice([*plain, *" ' a"]) for _ in range(40)) for _ in range(500)]
    texts += ["", " ", "<|endoftext|> a", "字 b", "İΣ", "don't stop... <|endoftext|", "\n\xa0"]
    for some in (texts, texts[::-1], ["字"], [""], []):
        got = list(encode.many(pa.array(some, pa.string())))
        assert got == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in some]
    assert max(len(encode.words), len(encode.words.older)) <= 50
    calls = []
    monkeypatch.setattr(encode.words, "_make", lambda word: calls.append(word) or b"\1\0\0\0")
    assert [len(x) for x in encode.many(pa.array([" ".join(["qzq"] * 3000), "qzq wvw qzq", "qzq"]))] == [12000, 12, 4]
    assert sorted(calls) == ["qzq", "wvw"]


def test_a_worker_holds_no_encoder_after_its_task(spark):
    def held(batches):
        import sys

        kept = sys.modules.get("_quietgate_worker")
        names = [str(k) for k in kept.__dict__.get("kept", {})] if kept else []
        for _ in batches:
            pass
        yield pa.record_batch({"names": pa.array([" ".join(names)])})

    assert packing.pieces(frame(spark, awkward()), PATH).count() > 0
    found = spark.range(64).repartition(16).mapInArrow(held, "names string").collect()
    assert not [r.names for r in found if "encoder" in r.names]
