"""Near copies among embeddings by lattice hashing.

Vectors are scaled to length 1, and each table projects them on 8 random orthonormal directions, scales by the cell width
and decodes to the nearest point of the E8 lattice, the densest packing in 8 dimensions, whose cells are near to round. A
vector lies in its own cell and probes the nearest of its neighbours among the 240 shortest lattice vectors around. Two
vectors meet in a table if one of them probes the other's cell. Pairs that meet are verified by cosine in double precision.

A cell may hold any number of vectors. Its members are dealt by hash into blocks of about `block` and pairs of blocks are
compared on their own, so no task holds a whole hot cell; no partner is dropped. Equal vectors are one node with a count.
Pairs stay where they are found: a block tells each of its rows how many partners it has there and the smallest node that its
links lead to. A pair that meets in several places counts in the first of them, which either row's cells tell.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths are not compared. Rows that repeat a vec_id count as further vectors of the same id;
links join different rows' vectors, and n_links counts the rows linked, itself not. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import cut, slices
from stratalog.llm.simhash import components, forest_of

#: With these a pair of cosine 0.95 meets in one table with probability 0.98 or more (measured in tests and the README).
TABLES, WIDTH, PROBES, BLOCK = 3, 0.20, 12, 1000


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 points of the rows of x, as integers: the better of the even integer points and those plus 1/2."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        gap = y - near
        worst = np.abs(gap).argmax(1)
        rows = np.arange(len(y))
        turned = near[rows, worst] + np.where(gap[rows, worst] >= 0, 1.0, -1.0)
        near[rows, worst] = np.where(near.sum(1) % 2 != 0, turned, near[rows, worst])
        return near

    whole, half = even(x), even(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(better[:, None], half, whole)).astype(np.int64)


@lru_cache(maxsize=1)
def e8_shortest() -> np.ndarray:
    """Twice the 240 shortest vectors of E8: two places of 1 or -1, and all places 1/2 or -1/2 with an even number of minus."""
    out = []
    for a, b in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[a], v[b] = s, t
            out.append(v)
    out += [list(v) for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


def _cell(points: np.ndarray, salt: int) -> np.ndarray:
    """One number for each point (rows of 8 small integers, doubled) of a table."""
    key = np.full(points.shape[:-1], salt, np.uint64)
    for i in range(8):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (points[..., i].astype(np.int64) + 512).astype(np.uint64)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


@lru_cache(maxsize=64)
def directions(dim: int, table: int, seed: int) -> np.ndarray:
    """(dim, 8) orthonormal columns; fewer dimensions than 8 are padded by zero rows."""
    rng = np.random.default_rng((seed, table))
    q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
    return q[:dim]


def cells_of(unit: np.ndarray, table: int, seed: int, width: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, probed): each row's own cell, and the cells of its `probes` nearest neighbours among the lattice points around."""
    x = unit @ directions(unit.shape[1], table, seed) / width
    own, around = e8_nearest(x), e8_shortest()
    gap = x - own / 2
    far = -(gap @ around.T)
    nearest = np.argpartition(far, probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), np.int64)
    salt = table << 32 | unit.shape[1]
    return _cell(own, salt), _cell(own[:, None, :] + around[nearest], salt)


def _plain(vector):
    """Components as doubles, without negative zeros."""
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; no overflow on the way."""
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _by_length(column, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a binary column's vectors, for each of their lengths."""
    data = column.to_pylist()
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([data[i] for i in at.tolist()]), kind).reshape(len(at), -1)


def nodes_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(node, vec, h1, h2, least_id, n): distinct vectors that can link, with a number, their bytes, two hashes, the least key and the rows."""
    rows = vectors.select(F.col(key).alias("id"), _plain(F.col(vector)).alias("v"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    grouped = rows.where(F.col("v").isNotNull() & good).groupBy("v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    # The numbers are fixed by the checkpoint.
    return cut(grouped.select(F.monotonically_increasing_id().alias("node"), "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "least_id", "n"))


def packed(nodes: DataFrame, kind: str) -> DataFrame:
    """(node, n, vec): the vectors' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = [np.asarray(v, np.float64).astype(kind).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], ["node", "n", "vec"])

    return nodes.select("node", "n", "v").mapInArrow(run, "node long, n long, vec binary")


def meetings(nodes: DataFrame, kind: str, tables: int, seed: int, width: float, probes: int) -> DataFrame:
    """(t, cell, node, home): each node's own cell in every table, and the cells that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                names = part.column(0).to_numpy()
                for at, matrix in _by_length(part.column(1), kind):
                    unit, node = unit_rows(matrix), names[at]
                    for t in range(tables):
                        own, probed = cells_of(unit, t, seed, width, probes)
                        cell = np.concatenate((own[:, None], probed), 1)
                        home = np.zeros(cell.shape, bool)
                        home[:, 0] = True
                        columns = (np.full(cell.size, t, np.int32), cell.ravel(), np.repeat(node, cell.shape[1]), home.ravel())
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "cell", "node", "home"])

    return nodes.select("node", "vec").mapInArrow(run, "t int, cell long, node long, home boolean")


class Comparer:
    """Compares the rows of a block; keeps the cells of its rows in the tables up to the block's."""

    def __init__(self, least: float, seed: int, width: float, probes: int):
        self.least, self.seed, self.width, self.probes = least, seed, width, probes

    def cells(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        return cells_of(unit, t, self.seed, self.width, self.probes)

    def new(self, x: np.ndarray, y: np.ndarray, unit: np.ndarray, node: np.ndarray, t: int) -> np.ndarray:
        """Which pairs (x[i], the member y[i]) of a table's cell did not meet before: in no earlier table, and not in x's own
        cell of this one if that is the place of the smaller node."""
        rows, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        a, b = at[: len(x)], at[len(x) :]
        fresh_ones = np.ones(len(x), bool)
        for table in range(t + 1):
            own, probed = self.cells(unit[rows], table)
            same = own[a] == own[b]
            if table < t:
                fresh_ones &= ~(same | (probed[a] == own[b][:, None]).any(1) | (probed[b] == own[a][:, None]).any(1))
            else:
                fresh_ones &= same | ~(probed[b] == own[a][:, None]).any(1) | (node[y] < node[x])
        return fresh_ones

    def block(self, matrix: np.ndarray, member: np.ndarray, node: np.ndarray, n: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(m, root): the rows' new partners, as often as they occur, and the place of the smallest node each is joined to."""
        unit, m = unit_rows(matrix), np.zeros(len(node), np.int64)
        single, own = unit.astype(np.float32), np.flatnonzero(member)
        root, order = np.arange(len(node)), np.argsort(node, kind="stable")
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        for at in range(0, len(node), 1024):
            # The product in single precision only screens; each pair's own sum of products decides.
            x, y = np.nonzero(single[at : at + 1024] @ single[own].T >= self.least - 1e-4)
            x, y = x + at, own[y]
            keep = np.flatnonzero((node[x] != node[y]) & (~member[x] | (place[x] > place[y])))
            for part in range(0, len(keep), 1 << 18):
                i, j = x[keep[part : part + (1 << 18)]], y[keep[part : part + (1 << 18)]]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= self.least
                i, j = i[near], j[near]
                if len(i):
                    first = self.new(i, j, unit, node, t)
                    np.add.at(m, i[first], n[j[first]])
                    np.add.at(m, j[first], n[i[first]])
                    # Roots are places in order of the nodes, so that the smallest is the root.
                    joined = forest_of(np.concatenate((place[i], place)), np.concatenate((place[j], place[root])), len(node))
                    root = order[joined[place]]
        return m, root


def near_counts(nodes: DataFrame, kind: str, least: float = 0.95, tables: int = TABLES, width: float = WIDTH, probes: int = PROBES, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """(node, root, m): for each place where a node has partners, how many rows they are, counted in one place each, and the
    smallest node that its links there lead to. The number of rows is bounded by that of the meetings."""
    vectors = cut(packed(nodes, kind))
    dealt = cut(meetings(vectors, kind, tables, seed, width, probes))
    homes = dealt.where("home").groupBy("t", "cell").agg(F.count(F.lit(1)).alias("held"))
    # Probes of cells without a vector lead nowhere. A cell's members and its probes go to blocks by hash.
    sized = dealt.join(homes, ["t", "cell"]).withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    at = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Every block of a cell meets each row of it once: as its members, and as rows of other blocks and probes that visit.
    placed = sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("member", F.col("home") & (at == F.col("at")))
    placed = placed.where(F.col("member") | ~F.col("home") | (at < F.col("at"))).select("t", "cell", "at", "node", "member")
    rows = placed.join(vectors, "node").select("t", "cell", "at", "member", "node", "n", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(least, seed, width, probes)

        def told(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.RecordBatch]:
            """What of the rows begins the next batch's block, and the results of all blocks before."""
            t, cell, at, member, node, n = (rows.column(i).to_numpy() for i in range(6))
            new = (cell[1:] != cell[:-1]) | (at[1:] != at[:-1]) | (t[1:] != t[:-1])
            ends = np.append(np.flatnonzero(new) + 1, len(cell))
            ends = ends if last else ends[:-1]
            begin, found = 0, []
            for end in ends.tolist():
                if end - begin > 1:
                    for own, matrix in _by_length(rows.column(6).slice(begin, end - begin), kind):
                        own = own + begin
                        if len(own) > 1 and member[own].any():
                            m, root = comparer.block(matrix, member[own], node[own], n[own], int(t[begin]))
                            hit = np.flatnonzero((m > 0) | (root != np.arange(len(own))))
                            if len(hit):
                                found.append((node[own[hit]], node[own[root[hit]]], m[hit]))
                begin = end
            arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]), pa.int64()) for i in range(3)]
            return rows.slice(begin), pa.RecordBatch.from_arrays(arrays, ["node", "root", "m"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rest, out = told(rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks(), False)
                yield out
        if rest is not None and rest.num_rows:
            yield told(rest, True)[1]

    return rows.repartition("t", "cell", "at").sortWithinPartitions("t", "cell", "at").mapInArrow(run, "node long, root long, m long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, **options) -> DataFrame:
    """(key, n_links, component, kept) of every row."""
    nodes = nodes_of(vectors, key, vector)
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    told = cut(near_counts(nodes, kind, least, **options))
    degree = told.groupBy("node").agg(F.sum("m").alias("m"))
    found = components(told.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = nodes.select("node", "h1", "h2", "n", "least_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least_id").alias("first"))
    of_node = grouped.join(names, "component").join(degree, "node", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "first")
    rows = vectors.select(F.col(key).alias("id"), _plain(F.col(vector)).alias("v")).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    out = rows.join(of_node, ["h1", "h2"], "left")
    component = F.coalesce("first", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), component.eqNullSafe(F.col("id")).alias("kept"))
