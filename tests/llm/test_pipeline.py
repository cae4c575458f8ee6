import random

import numpy as np

import corpus_pipeline
from stratalog.llm import simhash


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def corpus():
    rnd = random.Random(12)
    texts = [" ".join(words(rnd, rnd.choice((60, 200, 700)))) for _ in range(40)]
    for base in texts[:20]:
        for _ in range(3):
            w = base.split()
            for _ in range(max(1, len(w) // 120)):
                w[rnd.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate([*texts, texts[3], texts[3].upper(), "", None, " "])]


def test_near_groups_equal_all_pairs(spark):
    rows = corpus()
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = [(i, shingles(t) if t and t.split() else set()) for i, t in rows]
    root = {i: i for i, _ in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(own):
        for j, y in own[:a]:
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    assert {i: find(i) for i, _ in own} == got


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n, common in ((300, 270), (5000, 4500)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[:common], rng.integers(0, 2**63, n - common, dtype=np.uint64)))
        x, y = (np.frombuffer(simhash.sketch_of(v), np.uint16) for v in (a, b))
        estimate = ((x == y) & (x > 0)).sum() / ((x > 0) | (y > 0)).sum()
        assert abs(estimate - common / (2 * n - common)) < 0.09


def test_drop_near_copies_keeps_rows_without_key_and_columns(spark):
    text = " ".join(words(random.Random(1), 80))
    rows = [(5, text, "a"), (3, text + " x", "b"), (9, "other words entirely here", "c"), (9, "other words entirely here", "c"), (None, text, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_key string")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.kept_key) for r in out.collect()), key=str) == sorted([(3, "b"), (9, "c"), (None, "d")], key=str)


def test_pipeline_stages_run_on_what_the_one_before_kept(spark, tmp_path):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        w = words(rnd, 60)
        rows.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w) + ".", "en", f"s{i % 3}", 0))
        labels.append((i, int(not bad), 0))
    rows += [(500, rows[1][1] + " end", "en", "s1", 0), (501, rows[2][1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + " ".join(words(rnd, 60)), "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = [r.doc_id for r in docs.collect()]
    assert set(seen["quality"]) == {i for i, *_ in rows if i % 4 or i >= 500}
    assert 500 not in seen["near_copies"] and {1, 501} <= set(seen["near_copies"])
    assert sorted(seen["no_secrets"]) == sorted(seen["near_copies"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(seen["source_mix"]) and all(r.exact for r in out)
    assert set(seen["source_mix"]) <= set(seen["no_secrets"])


def test_a_real_pair_behind_a_smaller_text_that_is_no_copy_is_found(spark):
    rnd = random.Random(5)
    copy = words(rnd, 300)
    other = copy[:]
    rnd.shuffle(other)
    swapped = copy[:]
    swapped[100], swapped[200] = swapped[200], swapped[100]
    rows = [(i, " ".join(w)) for i, w in ((1, other), (2, copy), (3, swapped))]
    assert dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == {1: 1, 2: 2, 3: 2}


def test_all_rows_of_a_meeting_are_compared_in_blocks_too(spark):
    rng = np.random.default_rng(3)
    bases = rng.integers(1, 65536, (30, simhash.SKETCH)).astype(np.uint16)
    sketches = np.repeat(bases, 6, axis=0)
    for i, row in enumerate(sketches):
        row[8:][rng.permutation(simhash.SKETCH - 8)[: (i % 6) * 8]] = i + 1
    sketches[:, :8] = 7  # one band for all
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sketches)], "node long, sketch binary")
    want = {(i, i - i % 6) for i in range(180)}
    for block in (4096, 50):
        got = {tuple(r) for r in simhash.components(simhash.near_links(df, 0.77 + simhash.SCREEN, block)).collect()}
        assert got == want


def edited(rnd, base, kind, fresh_words):
    """A copy of which one part of so many words is cut, added, or exchanged as a whole."""
    at = rnd.randrange(len(base) - fresh_words + 1)
    new = [f"n{rnd.randrange(10**9)}" for _ in range(fresh_words)]
    return {"truncated": base[:-fresh_words], "extended": base + new, "swapped": base[:at] + new + base[at + fresh_words :]}[kind]


def recall(rnd, n, kind, similarity, rounds=30):
    """Share of copies at the least similarity not under the given one that meet in a key and pass the screen; the rest is exact."""
    kept = 0
    for _ in range(rounds):
        base = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
        a = simhash.shingle_hashes([w.encode() for w in base], 5, 42)
        edit = (lambda size: scattered(rnd, base, size)) if kind == "scattered" else (lambda size: edited(rnd, base, kind, size))
        size, last = 1, a
        while True:
            b = simhash.shingle_hashes([w.encode() for w in edit(size)], 5, 42)
            if simhash.similarity(np.unique(a), np.unique(b)) < similarity:
                break
            last, size = b, size + 1
        x, y = (np.frombuffer(simhash.sketch_of(v), np.uint16) for v in (a, last))
        kept += bool((simhash.band_keys(x) == simhash.band_keys(y)).any() and len(simhash.linked(np.stack((x, y)), 0.8, [np.unique(v) for v in (a, last)])) == 1)
    return kept / rounds


def scattered(rnd, base, n):
    """A copy of which n words, anywhere, are others."""
    at = set(rnd.sample(range(len(base)), n))
    return [f"n{rnd.randrange(10**9)}" if i in at else w for i, w in enumerate(base)]


def test_edits_at_the_threshold_are_found():
    rnd = random.Random(8)
    for n in (100, 300, 1000):
        for kind in ("truncated", "extended", "swapped", "scattered"):
            assert recall(rnd, n, kind, 0.8) >= 0.9, (n, kind)


def test_groups_at_the_threshold_are_exact(spark):
    """Chains of copies just above and just below the threshold, whose sketches cannot tell."""
    rnd = random.Random(21)
    rows, want = [], {}
    for group in range(12):
        base = words(rnd, 250)
        for kind, n in (("self", 0), ("above", 24), ("below", 33), ("both", 12)):
            text = base if not n else base[:-n] + words(rnd, n)
            rows.append((len(rows), " ".join(text)))
    own = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a, (i, x) in enumerate(own):
        for j, y in own[:a]:
            s = len(x & y) / len(x | y)
            near += 0.72 < s < 0.8
            if s >= 0.8:
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    assert near > 10
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: find(i) for i, _ in rows}


def test_empty_tables_and_tables_without_labels(spark, tmp_path):
    kind, labels = "doc_id long, text string, lang string, source string, n_chars long", spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (None, "", "en", "b", 0), (3, "four five six seven", "en", "b", 19)]
    for name, own in (("empty", []), ("odd", rows)):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, kind).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in out} <= {1, 3} and bool(out) == bool(own) and all(r.exact for r in out)


def prints_of(text):
    return np.frombuffer(simhash.wide_print(np.unique(simhash.shingle_hashes(text.lower().encode().split(), 5, 42))), ">u4")


def meet(x, y):
    differing = np.bitwise_count(x ^ y)
    return bool(differing.min() <= 4 and differing.sum() <= simhash.FAR)


def test_ball_hashing_finds_edits_at_the_threshold():
    rnd = random.Random(18)
    for n in (30, 100, 300, 1000):
        for kind in ("truncated", "extended", "swapped", "scattered"):
            kept = 0
            for _ in range(40):
                base = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
                size = 0
                while len(shingles(" ".join(base)) & (other := shingles(" ".join(edit := scattered(rnd, base, size + 1) if kind == "scattered" else edited(rnd, base, kind, size + 1))))) >= 0.8 * len(shingles(" ".join(base)) | other):
                    size, last = size + 1, edit
                kept += meet(prints_of(" ".join(base)), prints_of(" ".join(last if size else base)))
            assert kept >= 0.9 * 40, (n, kind, kept)


def test_ball_candidates_join_all_pairs_within_the_radius(spark):
    rows = [(i, t) for i, t in corpus() if t and t.split()]
    prints = {i: prints_of(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and meet(prints[i], prints[j]):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in prints.items()], "node long, wide binary")
    pairs = [tuple(r) for r in simhash.ball_candidates(nodes, nodes.count()).collect()]
    assert pairs and all(a > b and meet(prints[a], prints[b]) for a, b in pairs)
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in prints} == {i: find(i) for i in prints}


def test_a_table_that_is_cut_leaves_no_shuffle_files(spark):
    import time

    from stratalog.llm.common import cut

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    rows = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().join(spark.range(7).repartition(5, "id").toDF("k"), "k")
    kept = cut(rows)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
