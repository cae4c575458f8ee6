"""The operators that use DataFrame functions only: SQL twins over the fixture, brute force, and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog.llm import mixing, quality_rules, queries_native, sharding

ROWS = [
    (1, "The quick brown fox jumps. " * 12, "a"),
    (2, None, "b"),
    (3, "", None),
    (4, "x y z\n\n x y z \nx y z\n" * 30, "b"),
    (5, "Home\nWord | word | word | more | more | items | here | too\n" + "".join(f"A sentence{i} of{i} many{i} words{i} that{i} ends{i} well{i}.\n" for i in range(9)), "a"),
    (6, "ein Wort und noch eins. " * 20 + "漢字 #$% <b>", "c"),
    (7, " \t\n\x0b\x0c\r ", "c"),
    (7, "SHOUT!! " * 60, "c"),
    (None, "no id but words. " * 20, None),
    (9, "w " * 2000, "a"),
]


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    df.withColumn("size", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("SHARD", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    urls = ["http://EXAMPLE.com/en/7?x", "https://a.example.net/de/80", "http://m.spam-farm.example.org/", "no scheme", None, "http://x.org/es/"]
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def as_rows(rows):
    return Counter(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries_native.SQL))
def test_sql_twins(spark, folder, name):
    out = queries_native.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries_native.SQL[name]})").fetchall()
    assert as_rows(map(tuple, out.collect())) == as_rows(want)


@pytest.mark.parametrize("name", sorted(queries_native.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries_native.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_repeat_words_equal_brute_force(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab" if i % 2 else "abcdefgh") for _ in range(rnd.randrange(60))) for i in range(60)]

    def plain(text):
        w = text.split()
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(windows)
        return len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", quality_rules.words_of(F.col("text")))
    assert {r.doc_id: r.n for r in quality_rules.repeat_words(df, "w", "n").collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_cleaning_removes_failing_lines_and_keeps_the_rest(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    assert quality_rules.clean(docs).columns == docs.columns
    assert "Home" not in out[5] and "|" not in out[5] and out[5].count("A sentence") == 9
    assert 2 not in out and 7 not in out


def plain_targets(sizes, weights=(3, 1, 2)):
    """By giving out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped and sizes[s]]
        share = {s: (total - sum(capped.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**dict.fromkeys(order, 0.0), **capped, **share}
        capped |= over


def test_targets_equal_repeated_sharing(spark):
    rnd = random.Random(6)
    for n in (2, 40):
        sizes = {f"s{i}": rnd.choice((0, 5, 50, 500, 100000)) for i in range(n)} | {None: 33, "é": 9}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_emits_each_document_as_often_as_planned_and_comes_near(spark):
    rows = [(i, "word " * (1 + i % 40), ("hot", "cold", None)[0 if i % 3 else i % 2 + 1]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_copies", F.lit("clash"))
    plan = mixing.plan_mix(docs.drop("mix_copies")).collect()
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in plan if r.copies})
    for source in ("hot", "cold", None):
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.05 * own[0].target
        assert all(r.copies <= 2 for r in own)


def plain_rounds(keys_at, shards, vnodes, seed):
    """Counts that each shard takes from each point, by asking row by row."""
    order, n = sharding.ring(shards, vnodes, seed), len(keys_at)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out, waiting = Counter(), Counter(keys_at)
    for r in range(shards):
        for point in sorted(waiting):
            s = order[point][r]
            got = min(waiting[point], room[s])
            room[s] -= got
            waiting[point] -= got
            out[point, s] += got
    return Counter({k: v for k, v in out.items() if v})


@pytest.mark.parametrize("n, shards", [(3, 8), (1000, 3)])
def test_shards_are_even_gapless_and_as_asked_row_by_row(spark, n, shards):
    rows = spark.range(n).select((F.col("id") % max(1, n - n // 4)).alias("k"), (F.col("id") % 2).alias("x"))
    got = sharding.assign_shards(rows, "k", shards=shards).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == n and (not n or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    points = {r.k: int(hashlib.md5(f"7\x02{r.k}".encode()).hexdigest()[:12], 16) % sharding.SLOTS for r in rows.collect()}
    assert Counter((points[r.k], r.shard) for r in got) == plain_rounds([points[r.k] for r in got], shards, 64, 7)


def test_more_shards_move_few_rows_with_slack(spark):
    rows = spark.range(4000).toDF("k")
    a, b = ({r.k: r.shard for r in sharding.assign_shards(rows, "k", shards=s, slack=0.2).collect()} for s in (4, 5))
    moved = sum(a[k] != b[k] for k in a)
    assert moved < 0.4 * len(a) and max(Counter(a.values()).values()) <= 1200


def test_hot_keys_and_repeated_rows(spark, folder):
    rows = spark.createDataFrame([(1, i % 3) for i in range(500)] + [(None, 0)] * 100 + [(i, 0) for i in range(900)], "k long, x long")
    got = sharding.assign_shards(rows, "k", shards=4).collect()
    assert Counter(r.shard for r in got) == Counter({s: 375 for s in range(4)})
    assert Counter((r.k, r.x) for r in got) == Counter((r.k, r.x) for r in rows.collect())
    out = queries_native.op4_ring_shards(spark, folder).collect()
    texts = Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == texts
