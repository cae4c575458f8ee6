import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import simhash


def plain_fingerprint(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, radius=4):
    """By comparison of all pairs."""
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = {}
    for i in range(len(pairs)):
        out.setdefault(find(i), []).append(pairs[i][0])
    return {x: min(xs) for xs in out.values() for x in xs}


def documents():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "漢字"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((3, 8, 60, 400)))) for _ in range(60)]
    for base in list(texts[:25]):
        for _ in range(4):
            words = base.split()
            words[rnd.randrange(len(words))] = "edited"
            texts.append("\n".join(words))
    texts += [texts[0]] * 3 + ["", None, " \t\n", "one", "ONE", "x " * 30000]
    return [(i, t) for i, t in enumerate(texts)]


def test_whole_operator_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component) for r in simhash.simhash_components(df).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert {i: f for i, (f, _) in got.items()} == dict(prints)
    assert {i: c for i, (_, c) in got.items()} == plain_components(prints)


def test_links_equal_brute_force_over_clustered_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            flip = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.add(int(b) ^ sum(1 << int(f) for f in flip))
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in rows], "fp long, node long")
    got = dict(simhash.components(simhash.ball_links(df, 5000)).collect())
    want = plain_components(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want
    pairs = {tuple(r) for r in simhash.ball_links(df, 5000, forest=False).collect()}
    assert all(bin(rows[a][1] ^ rows[b][1]).count("1") <= 4 and a > b for a, b in pairs)


@pytest.mark.parametrize("block", [1 << 22, 500])
def test_blocks_do_not_change_the_meetings(block):
    rng = np.random.default_rng(8)
    fps = np.unique(np.concatenate([np.uint64(7) ^ simhash.flips(64, 1)[:40], rng.integers(0, 2**60, 30, dtype=np.uint64)]))
    found = {(int(x), int(y)) for a, b in simhash.meetings(fps, 0, 4, 2, block=block) for x, y in zip(a, b, strict=True)}
    want = {(int(x), int(y)) for a, b in simhash.meetings(fps, 0, 4, 2) for x, y in zip(a, b, strict=True)}
    assert found == want and found


def test_chain_and_hub_components(spark):
    links = [(i + 1, i) for i in range(60)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5001)]
    got = dict(simhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and got[5001] == 5000


def test_empty_table_and_null_keys(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (None, "something quite different here now")], "doc_id long, text string")
    assert [r.component for r in simhash.simhash_components(rows).collect()] == [None, None]
