import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from stratalog.llm import pieces
from stratalog.llm.queries_free import PIECES_MODEL

DATA = pieces.load(PIECES_MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES_MODEL)


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes((n & 127 | 128,)), n >> 7
    return out + bytes((n,))


def small_model(words, kind):
    """A model file with bytes, characters and words, as the library reads it."""
    def field(number, data):
        return _varint(number << 3 | 2) + _varint(len(data)) + data

    def piece(text, score, k):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(k))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    out += b"".join(piece(w, s, 1) for w, s in words)
    trainer = b"\x18" + _varint(kind) + _varint(35 << 3) + _varint(1)
    normalizer = field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    return out + field(2, trainer) + field(3, normalizer)


def texts(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "漢", "字", "x", "1", "0000", "....", "-", "in", "ing", "er", "the", "\U0001f600", "     ", "\x00", "token", "abab"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(n)]


def test_bpe_ids_equal_the_library():
    mine = pieces.Pieces(DATA, memo=500)
    for text in texts(3, 4000):
        assert mine.encode(text) == LIBRARY.encode(text), text
        assert mine.decode(mine.encode(text)) == text


def test_long_runs_and_words_are_linear_and_exact():
    mine = pieces.Pieces(DATA)
    for text in (" " * 30001 + "a", "ab" * 20000, "the " * 20000, "\n" * 5000, "漢" * 3000):
        ids = mine.encode(text)
        assert ids == LIBRARY.encode(text) and mine.decode(ids) == text


def test_viterbi_equals_the_library_on_a_unigram_model():
    rnd = random.Random(4)
    words = {"▁": -3.0, "t": -4.0, "h": -4.5, "e": -3.5, "a": -3.25, "b": -5.0, "x": -6.0, "1": -6.5, "0": -6.25, "i": -4.0, "n": -4.0, "g": -4.75, "r": -4.25}
    for w in ("th", "he", "the", "▁the", "▁th", "er", "ing", "in", "▁a", "ab", "abab", "ba", "▁x", "00", "0000", "en", "▁▁"):
        words[w] = -rnd.randrange(16, 60) / 4
    data = small_model(list(words.items()), 1)
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    assert mine.kind == pieces.UNIGRAM

    def score(ids):
        return sum(mine.table[i][1] for i in ids)

    for text in texts(9, 3000):
        ids, theirs = mine.encode(text), library.encode(text)
        assert mine.decode(ids) == text
        assert ids == theirs or abs(score(ids) - score(theirs)) < 1e-4, text


def test_viterbi_equals_brute_force():
    data = small_model([("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -4.0), ("aba", -4.75), ("▁", -1.0), ("▁a", -2.75)], 1)
    mine = pieces.Pieces(data)
    table = {p: s for p, s, k in mine.table if k == 1}

    def best(s):
        return 0.0 if not s else max(table[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in table)

    for text in ("abab", "aabba", "a b aba", "bababab", "  aa"):
        assert abs(sum(mine.table[i][1] for i in mine.encode(text)) - best("▁" + text.replace(" ", "▁"))) < 1e-9


def test_null_empty_and_mark():
    mine = pieces.Pieces(DATA)
    assert mine.encode(None) is None and mine.encode("") == [] and mine.decode([]) == "" and mine.decode(None) is None
    assert mine.decode(mine.encode("a▁b")) == "a b"


@pytest.mark.parametrize("rows", [[], [(1, "one two"), (2, None), (2, ""), (None, "x  y")]])
def test_operator(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    out = pieces.encode_documents(df, DATA)
    got = sorted(((r.doc_id, r.ids, r.exact) for r in out.collect()), key=str)
    assert got == sorted(((i, None if t is None else LIBRARY.encode(t), None if t is None else True) for i, t in rows), key=str)
    back = pieces.decode_documents(out, DATA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
