import numpy as np
import pytest

from stratalog.llm import lattice


def plain(rows, least=0.95):
    good = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, unit = [i for i, _ in good], np.array([v for _, v in good])
    near = np.einsum("ik,jk->ij", unit, unit) >= least
    np.fill_diagonal(near, False)
    label = list(range(len(ids)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))], key=lambda k: ids[k]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    out = {i: (0, i, True) for i, _ in rows}
    return out | {ids[i]: (int(near[i].sum()), ids[label[i]], ids[label[i]] == ids[i]) for i in range(len(ids))}


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 32))
    rows = [*base, *(base[i % 20] * rng.uniform(0.1, 9) + 0.06 * np.linalg.norm(base[i % 20]) / 5.6 * rng.standard_normal(32) * (1 + i % 4) for i in range(160))]
    rows += [base[0]] * 5 + [base[1] * 7, np.zeros(32), -base[0]]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return [*out, (900, None), (901, [float("nan")] * 32), (902, [None] + [1.0] * 31), (903, [float("inf")] + [1.0] * 31), (904, []), (905, [1e-300] * 32), (906, [1e300] * 32)]


@pytest.mark.parametrize("block", [1000, 7])
def test_links_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component, r.kept) for r in lattice.near_vectors(df, block=block).collect()}
    want = plain([(i, v) for i, v in rows if i < 905])
    assert {i: got[i] for i in want} == want
    assert got[905][0] == got[906][0] == 1 and got[906][1] == 905


def test_recall_at_the_threshold_and_decoding():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.standard_normal(x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for t in range(lattice.TABLES):
        (a, p), (b, _) = (lattice.cells_of(z, t, 5, lattice.WIDTH, lattice.PROBES) for z in (x, y))
        met |= (a == b) | (p == b[:, None]).any(1)
    assert met.mean() > 0.995
    around = lattice.e8_shortest()
    assert len(np.unique(around, axis=0)) == 240 and set((around**2).sum(1)) == {8}
    z = rng.uniform(-3, 3, (300, 8))
    own = lattice.e8_nearest(z)
    best = ((z - own / 2) ** 2).sum(1)
    assert (best <= ((z[:, None] - (own[:, None] + around[None]) / 2) ** 2).sum(2).min(1) + 1e-9).all() and (best <= 1 + 1e-9).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_vectors(df).count() == 0
