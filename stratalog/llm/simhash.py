"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most r bits meet in a value that is within r / 2 bits of both. So every
fingerprint emits all its variants within half the radius (2081 for r = 4), and fingerprints with a variant in common are
linked. By the triangle inequality each such link is within r, and no link is missed.

The shuffle goes by the variants' first bits. A fingerprint is sent once to each prefix that its variants can have, and the
part of that prefix makes the variants that begin with it. That moves tens of rows for each fingerprint in place of
thousands, and the number of prefix bits grows with the table so that a part keeps its size. Within a part variants are
sorted in blocks of bounded memory; equal neighbours are links, and only what a spanning forest needs leaves the part (or,
where links have to be verified by another measure, one pair for each fingerprint and smallest companion).

Connected components come from alternating large and small stars over checkpointed tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import cut, fresh, slices, swept

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8).astype(np.int64)
#: Variants that a part should hold, and the most that are sorted at once.
PART_VARIANTS, BLOCK_VARIANTS = 1 << 21, 1 << 22


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased. bytes.split() parts at exactly the six white space bytes."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of each run of k words joined by spaces, repeats included; of all words if they are fewer; none of none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    if n <= k:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The value whose bits are 1 where over half of the hashes have a 1; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    at = hashes.astype(">u8").view(np.uint8).reshape(n, 8).astype(np.int64) + np.arange(8) * 256
    ones = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp long) of each document: the majority of its word shingles' hashes, over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                fps = [_signed(majority(shingle_hashes(words_of(t), k, seed))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, fp long").withColumnRenamed("key", key)


@lru_cache(maxsize=64)
def flips(bits: int, most: int) -> np.ndarray:
    """All masks of `bits` low bits with at most `most` ones, in order of their number of ones."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n by the links a-b: labels spread and are shortcut until nothing changes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(deeper := new[new], new):
            new = deeper
        if np.array_equal(new, root):
            return root
        root = new


def runs(fps: np.ndarray, prefix: int, prefix_bits: int, half: int, fp_bits: int = 64, block: int = BLOCK_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, starts): indices into fps, run by run those that share a variant beginning with prefix, and where each run starts.

    Blocks go by the next bits of the variants, as many as bounded memory needs.
    """
    low_bits = fp_bits - prefix_bits
    split = 0
    while split < min(low_bits - 1, 16) and len(fps) * len(flips(min(low_bits, 64), half)) >> split > 2 * block:
        split += 1
    keep = low_bits - split
    masks = [flips(keep, n) for n in range(half + 1)]
    low_mask = np.uint64((1 << keep) - 1)
    for piece in range(1 << split):
        head = np.uint64((prefix << split) | piece)
        top = fps >> np.uint64(keep) if keep < 64 else np.zeros(len(fps), np.uint64)
        spent = _ones(top ^ head)
        values, owners = [], []
        for used in range(half + 1):
            who = np.flatnonzero(spent == used)
            if len(who):
                m = masks[half - used]
                values.append(((fps[who] & low_mask)[:, None] ^ m[None, :]).ravel())
                owners.append(np.repeat(who, len(m)))
        if not values:
            continue
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = value[1:] == value[:-1]
        if not same.any():
            continue
        yield owner, np.flatnonzero(np.concatenate(([True], ~same)))


def meetings(fps: np.ndarray, prefix: int, prefix_bits: int, half: int, fp_bits: int = 64, block: int = BLOCK_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the runs: b is the run's first, a a later one. fps: distinct, ascending order decides which index is first."""
    for owner, starts in runs(fps, prefix, prefix_bits, half, fp_bits, block):
        first = np.repeat(np.minimum.reduceat(owner, starts), np.diff(starts, append=len(owner)))
        later = np.flatnonzero(first != owner)
        yield owner[later], first[later]


def _pairs(fps: np.ndarray, prefix: int, prefix_bits: int, half: int) -> np.ndarray:
    """Distinct (a, b) pairs of all meetings, as rows."""
    found = np.zeros((0, 2), np.int64)
    for a, b in meetings(fps, prefix, prefix_bits, half):
        found = np.unique(np.concatenate((found, np.stack((a, b), 1))), axis=0)
    return found


def prefix_bits_for(n: int, radius: int) -> int:
    """Prefix bits with which a part holds about PART_VARIANTS variants."""
    variants = len(flips(64, radius // 2))
    return int(min(40, max(3, np.ceil(np.log2(max(1, n) * variants / PART_VARIANTS)))))


def ball_links(prints: DataFrame, n: int, radius: int = 4, forest: bool = True) -> DataFrame:
    """(a, b) node links of fingerprints that differ in at most `radius` (even) bits, from prints (fp long, node long).

    fp must be distinct. forest: links that keep the components of all links; else, for every fingerprint and variant, a
    link to the smallest node with that variant, each pair once, for a verification to follow.
    n: the number of prints, which sets how finely they are dealt and nothing else.
    """
    half, bits = radius // 2, prefix_bits_for(n, radius)
    masks = [int(m) for m in flips(bits, half)]
    part = F.explode(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>"))
    dealt = prints.select("fp", "node", part.alias("mask")).select(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("mask")).alias("part"), "fp", "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        fps, nodes = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        found = _pairs(fps, int(pdf["part"].iloc[0]), bits, half)
        if forest:
            root = forest_of(found[:, 0], found[:, 1], len(fps))
            who = np.flatnonzero(root != np.arange(len(fps)))
            found = np.stack((who, root[who]), 1)
        return pd.DataFrame({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    links = dealt.groupBy("part").applyInPandas(run, "a long, b long")
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by the links (a, b), for every node in a link.

    Alternating large and small stars (Kiveris et al. 2014). Both join with a minimum that is aggregated before the
    shuffle, so that a hub's links are never in one place. Each round's table is checkpointed; the rounds end when a table
    equals the one before.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())

    def told(df: DataFrame) -> tuple:
        return tuple(swept(df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s"))).collect()[0])

    before = told(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(small.where("u > v").distinct())
        after = told(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(key, fp, component): each document's fingerprint and the smallest key reachable by links of at most `radius` bits.

    Equal fingerprints are one node, named by their smallest key. A null or empty text has fingerprint 0 and links like any
    other. A row whose key is null gets the component of its fingerprint's other rows; without such rows it is null.
    """
    marked = cut(fingerprints(docs, key, text, k, seed))
    nodes = cut(marked.groupBy("fp").agg(F.min(key).alias("node")))
    named = nodes.where(F.col("node").isNotNull())
    found = components(ball_links(named, named.count(), radius))
    resolved = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return marked.join(resolved, "fp").select(key, "fp", "component")


#: Near copies: the word shingles' sketch of SKETCH bins is read as BANDS keys; texts with a key in common are compared. A pair
#: whose sketches estimate no more than SCREEN less than the threshold, three standard deviations, is compared exactly. BLOCK is the
#: number of texts of one key that are compared in one place; more of them are dealt out in pairs of blocks.
SKETCH, BANDS, SCREEN, BLOCK = 256, 32, 0.08, 4096


def sketch_of(hashes: np.ndarray, size: int = SKETCH) -> bytes:
    """One-permutation MinHash of a set of 64-bit hashes: the least rest in each of `size` bins, 16 bits of each, 0 if none."""
    out = np.zeros(size, np.uint16)
    if len(hashes):
        mixed = np.unique(hashes)[::-1]
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        rest = (mixed >> np.uint64(8)) % np.uint64(65535) + np.uint64(1)
        by = np.argsort(mixed, kind="stable")[::-1]
        # The last one written to a bin is its least.
        out[(mixed[by] % np.uint64(size)).astype(np.int64)] = rest[by].astype(np.uint16)
    return out.tobytes()


#: Near copies by ball hashing: a SimHash of PRINTS * 32 bits is read as PRINTS fingerprints of 32 bits; texts meet where one of these
#: differs in 4 bits or fewer, and are candidates if FAR or fewer of all bits differ. At similarity 0.8 a bit differs with
#: probability 0.15, so that is over three standard deviations above what copies have. A part gets about PART_ROWS fingerprints.
PRINTS, FAR, PART_ROWS = 8, 60, 1 << 20
_SEEDS = np.array([[0x9E3779B97F4A7C15], [0xBF58476D1CE4E5B9], [0x94D049BB133111EB], [0xD6E8FEB86659FD93]], np.uint64)


def wide_print(hashes: np.ndarray) -> bytes:
    """The SimHash of PRINTS * 32 bits of a set of 64-bit hashes: each bit's majority over the hashes, mixed anew for each 64 bits."""
    n = len(hashes)
    mixed = (hashes[None, :] ^ (hashes[None, :] >> np.uint64(32))) * _SEEDS
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    at = np.ascontiguousarray(mixed.T).view(np.uint8).reshape(n, PRINTS * 4).astype(np.int64) + np.arange(PRINTS * 4) * 256
    ones = np.bincount(at.ravel(), minlength=PRINTS * 1024).reshape(-1, 256) @ _BYTE_BITS
    return np.packbits(2 * ones.ravel() > n).tobytes()


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those links a-b, as rows, that join groups without a circle, and the labels of the groups then."""
    out = [np.zeros((0, 2), np.int64)]
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return np.concatenate(out), label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        one = np.unique(np.maximum(x, y), return_index=True)[1]
        out.append(np.stack((a[one], b[one]), 1))
        label = forest_of(x[one], y[one], len(label))[label]


def near_in_runs(found: Iterator[tuple[np.ndarray, np.ndarray]], wide: np.ndarray, far: int = FAR) -> np.ndarray:
    """Links, as rows, of indices in a run with `far` or fewer differing bits; they join all such pairs of all runs.

    All of a run are compared with each other, but for those that links join already.
    """
    label, out = np.arange(len(wide)), [np.zeros((0, 2), np.int64)]
    for owner, starts in found:
        run = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(owner)))
        step = 0
        while len(owner):
            starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            size, own = np.diff(starts, append=len(run)), label[owner]
            step += 1
            live = np.repeat((size > step) & (np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)), size)
            owner, run = owner[live], run[live]
            at = np.flatnonzero(run[step:] == run[:-step])
            a, b = owner[at + step], owner[at]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            near = np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= far
            links, label = spanning(a[near], b[near], label)
            out.append(links)
    return np.concatenate(out)


def ball_candidates(nodes: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """(a, b), a > b: pairs of nodes (node, wide) of which a fingerprint differs in at most `radius` (even) bits, and the whole in
    FAR or fewer; they keep the components of all such pairs. n: the number of nodes, which sets how finely they are dealt.
    """
    half = radius // 2
    bits = next(p for p in range(3, 28) if n * len(flips(p, half)) >> p <= PART_ROWS or p == 27)
    masks = flips(bits, half)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1):
                prints = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u4").reshape(-1, PRINTS).astype(np.uint64)
                parts = ((prints >> np.uint64(32 - bits))[:, :, None] ^ masks) | (np.arange(PRINTS, dtype=np.uint64)[:, None] << np.uint64(bits))
                again = pa.array(np.repeat(np.arange(rows.num_rows), PRINTS * len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(parts.ravel().astype(np.int64)), rows.column(0).take(again), rows.column(1).take(again)], ["part", "node", "wide"])

    def run(rows: pa.Table) -> pa.Table:
        part, node = rows.column("part")[0].as_py(), rows.column("node").to_numpy()
        prints = np.frombuffer(b"".join(rows.column("wide").to_pylist()), ">u4").reshape(-1, PRINTS)
        fps = prints[:, part >> bits].astype(np.uint64)
        found = near_in_runs(runs(fps, part & ((1 << bits) - 1), bits, half, 32), prints.view(np.uint64))
        ends = node[found]
        return pa.table({"a": ends.max(1), "b": ends.min(1)})

    dealt = nodes.select("node", "wide").mapInArrow(deal, "part long, node long, wide binary")
    return dealt.groupBy("part").applyInArrow(run, "a long, b long").distinct()


def marks(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, digest, sketch, grams, wide): the k-word shingles' sketch, their set as sorted 32-bit hashes, the digest of both, and
    the set's SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for part in slices(batch, 1):
                hashes = [np.unique(shingle_hashes(words_of(t), k, 42)) for t in part.column(1).to_pylist()]
                sketches = [sketch_of(h) for h in hashes]
                grams = [np.unique(h.astype(np.uint32)).astype("<u4").tobytes() for h in hashes]
                digests = [xxh3_128_digest(x + y) for x, y in zip(sketches, grams, strict=True)]
                wide = [wide_print(h) for h in hashes]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in (digests, sketches, grams, wide))], ["key", "digest", "sketch", "grams", "wide"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, digest binary, sketch binary, grams binary, wide binary")


@lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For each bin the place of every bin in the order in which it looks for one that is filled."""
    return np.random.default_rng(11).permuted(np.tile(np.arange(SKETCH, dtype=np.int16), (SKETCH, 1)), axis=1)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS keys of a sketch; none of an empty one. An empty bin takes the value of the first filled one in its own order
    (densified one-permutation hashing), so that short texts meet as surely as long ones."""
    filled = np.flatnonzero(sketch)
    if not len(filled):
        return np.zeros(0, np.uint64)
    if len(filled) < len(sketch):
        empty = np.flatnonzero(sketch == 0)
        sketch = sketch.copy()
        sketch[empty] = sketch[filled[_probes()[np.ix_(empty, filled)].argmin(1)]]
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in sketch.view(np.uint64).reshape(BANDS, -1).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _banded(nodes: DataFrame) -> DataFrame:
    """(key, node, group) for every band key of nodes (node, sketch, group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys = [band_keys(np.frombuffer(s, np.uint16)) for s in part.column(1).to_pylist()]
                owner, group = (np.repeat(part.column(i).to_numpy(), [len(x) for x in keys]) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(owner, pa.int64()), pa.array(group, pa.int64())], ["key", "node", "group"])

    return nodes.select("node", "sketch", "group").mapInArrow(run, "key long, node long, group long")


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(x) and not len(y):
        return 1.0
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (len(both) - common)


def linked(sketches: np.ndarray, least: float, grams: list[np.ndarray] | None = None) -> np.ndarray:
    """(later, first) pairs of similar rows that join all rows which are similar to each other, directly or over others.

    Similar are those whose sketches agree in `least` less SCREEN of the bins that either fills, and, with grams, whose sets'
    similarity is `least`. Every row that was reached is compared with all that were not, so no pair that could join two groups
    is left out.
    """
    filled = sketches > 0
    rest, out = np.arange(len(sketches)), []
    while len(rest) > 1:
        head, rest = rest[0], rest[1:]
        reached = [head]
        while reached and len(rest):
            at = reached.pop()
            same = np.count_nonzero((sketches[rest] == sketches[at]) & filled[at], axis=1)
            hit = same >= (least - SCREEN) * np.count_nonzero(filled[rest] | filled[at], axis=1)
            if grams is not None:
                for i in np.flatnonzero(hit).tolist():
                    hit[i] = similarity(grams[rest[i]], grams[at]) >= least
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                out.append(np.stack((new, np.full(len(new), at)), 1))
                reached += new.tolist()
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def near_links(nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b) similar pairs of nodes (node, sketch, and grams or not) that keep the components of all similar pairs with a band key
    in common; similar as `linked` has it.

    Keys with the same nodes count once. The nodes of a key are compared with each other where they meet; beyond `block` of
    them they are dealt to blocks, and each two blocks meet. Nodes may have a `group`, which links join already: a key whose nodes
    are all of one group has nothing to add.
    """
    exact = "grams" in nodes.columns
    banded = _banded(nodes if "group" in nodes.columns else nodes.withColumn("group", F.col("node")))
    sets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), (F.min("group") < F.max("group")).alias("open"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    kept = sets.where("open").groupBy("n", "lo", "hi", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    own = F.expr("pmod(xxhash64(node, 3), blocks)")
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least("own", j) * F.col("blocks") + F.greatest("own", j))
    members = banded.drop("group").join(kept, "key").withColumn("own", own).select("key", "node", F.explode(met).alias("met"))
    carried = ["sketch", "grams"] if exact else ["sketch"]
    dealt = members.join(nodes.select("node", *carried), "node").select("key", "met", "node", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.RecordBatch]:
            """What of the rows begins the next batch's group, and the links of all groups before."""
            key, met, node = (rows.column(i).to_numpy() for i in range(3))
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]) | (met[1:] != met[:-1])) + 1, len(key))
            ends = ends if last else ends[:-1]
            at, a, b = 0, [], []
            if len(ends):
                sketches = np.frombuffer(b"".join(rows.column(3).slice(0, ends[-1]).to_pylist()), np.uint16).reshape(ends[-1], -1)
            for end in ends.tolist():
                grams = [np.frombuffer(x, "<u4") for x in rows.column(4).slice(at, end - at).to_pylist()] if exact else None
                found = linked(sketches[at:end], least, grams) + at
                a.append(node[found[:, 0]])
                b.append(node[found[:, 1]])
                at = end
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (a, b)]
            return rows.slice(at), pa.RecordBatch.from_arrays(arrays, ["a", "b"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rest, out = links(rows if rest is None else pa.concat_tables([rest, rows]), False)
                yield out
        if rest is not None and rest.num_rows:
            yield links(rest, True)[1]

    return dealt.repartition("key", "met").sortWithinPartitions("key", "met").mapInArrow(run, "a long, b long").distinct()


def verified(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similar): whether the sets (node, grams) of each link are similar by `least`, exactly."""
    sides = [sets.toDF(side, f"grams_{side}") for side in ("a", "b")]
    rows = links.join(sides[0], "a").join(sides[1], "b").select("a", "b", "grams_a", "grams_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                x, y = ([np.frombuffer(g, "<u4") for g in part.column(i).to_pylist()] for i in (2, 3))
                hit = [similarity(i, j) >= least for i, j in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hit, pa.bool_())], ["a", "b", "similar"])

    return rows.mapInArrow(run, "a long, b long, similar boolean")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8) -> DataFrame:
    """(key, component) of near copies: the smallest key of each group, for every row with a key.

    Texts of one set of k-word shingles are one node. Candidates come from ball hashing of the SimHash of that set, and each is
    verified by the sets themselves: first every node's candidate with the smallest node, then those between groups that this
    leaves apart. The few pairs that ball hashing misses (measured in the README) are looked for among nodes with a band of
    their sketches in common, but only where these are of different groups. There candidates are screened by their sketches, every
    link is verified by the sets too, and groups in which one fails are compared again, with the sets at hand, so that no pair
    behind it is lost. Nodes without a word are one group.
    """
    marked = cut(marks(docs, key, text, k))
    nodes = cut(marked.groupBy("digest").agg(F.min("key").alias("node"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")).where("node IS NOT NULL"))

    def sets_of(names: DataFrame) -> DataFrame:
        """(node, grams) of the nodes named."""
        asked = nodes.join(names, "node", "left_semi").select("node", F.col("digest").alias("of"))
        return marked.join(asked, (F.col("key") == F.col("node")) & (F.col("digest") == F.col("of"))).select("node", "grams").dropDuplicates(["node"])

    def judged(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        return cut(verified(links, sets_of(ends), least))

    def grouped(links: DataFrame) -> DataFrame:
        """(node, group): the nodes and the groups that the links join."""
        return cut(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("group")))

    met = cut(ball_candidates(nodes.where(F.col("wide") != F.lit(bytes(PRINTS * 4))), nodes.count()))
    good = judged(met.groupBy("a").agg(F.min("b").alias("b"))).where("similar").select("a", "b")
    groups = grouped(good)
    apart = met.join(groups.toDF("a", "group_a"), "a").join(groups.toDF("b", "group_b"), "b").where("group_a <> group_b").select("a", "b")
    more = judged(cut(apart)).where("similar").select("a", "b")
    if more.take(1):
        good = good.union(more)
        groups = grouped(good)
    rest = cut(nodes.select("node", "sketch").join(groups, "node"))
    links = cut(near_links(rest, least))
    told = judged(links)
    good = good.union(told.where("similar").select("a", "b"))
    if told.where("NOT similar").take(1):
        whole = cut(components(links))
        open_groups = told.where("NOT similar").select(F.col("a").alias("node")).join(whole, "node").select("component").distinct()
        again = cut(whole.join(open_groups, "component", "left_semi").select("node"))
        asked = cut(rest.join(again, "node", "left_semi").join(sets_of(again), "node"))
        good = good.union(near_links(asked, least))
    found = components(good)
    resolved = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return marked.where("key IS NOT NULL").select("key", "digest").join(resolved, "digest").select("key", "component")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near copies: that with the smallest key. Rows without a key stay, as nothing names them.

    Rows that repeat the smallest key with the same text are one row in the result.
    """
    first = near_groups(docs, key, text, **options).where("key = component").select(F.col("key").alias("kept_key")).distinct()
    (own,) = fresh(docs, "kept_key")
    kept = docs.join(first.withColumnRenamed("kept_key", own), F.col(key) == F.col(own), "left_semi")
    return kept.dropDuplicates([key]).union(docs.where(F.col(key).isNull()))
