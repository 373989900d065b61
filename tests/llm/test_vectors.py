import numpy as np

from rasterloom.llm.ann import chi_square_quantile, nearest
from rasterloom.llm.vectors import near_vectors


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "other") for i, v in rows], "vec_id long, embedding array<float>, id string")


def planted(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 32))
    for k in range(0, 120, 3):
        x[k + 1] = x[k] + rng.standard_normal(32) * np.linalg.norm(x[k]) / np.sqrt(32) * 0.2
        x[k + 2] = x[k] * 3
    x[200:215] = x[200]
    return list(enumerate(x.astype(np.float32)))


def test_links_against_all_cosines(spark):
    data = planted()
    odd = [(900, None), (901, []), (902, [0] * 32), (903, [float("nan")] * 32), (904, [1, None] * 16), (905, [1, 2]), (906, [2, 4])]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, data + odd)).collect()}
    x = np.array([v for _, v in data], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    root = np.arange(len(x))
    for _ in range(20):
        root = np.array([root[n].min() for n in near])
    for i in range(len(x)):
        assert got[i] == (near[i].sum() - 1, root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(900, 905))
    assert got[905] == (1, 905, True) and got[906] == (1, 905, False)
    assert near_vectors(frame(spark, data).limit(0)).count() == 0


def test_large_groups_are_dealt_into_blocks(spark, monkeypatch):
    import rasterloom.llm.vectors as m

    monkeypatch.setattr(m, "BLOCK", 7)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    data = [(k, centre + rng.standard_normal(16) * 0.02) for k in range(40)]
    got = near_vectors(frame(spark, data)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(39, 0)}


def test_neighbours_against_all_distances(spark):
    from pyspark.sql import functions as F

    data = planted(1)
    odd = [(900, None), (910, [0] * 32), (920, [float("inf")] * 32), (930, [1, 2])]
    out = nearest(frame(spark, data + odd), F.col("vec_id") % 10 == 0, k=5).collect()
    x = np.array([v for _, v in data], dtype=np.float64)
    hit = total = 0
    for q in range(0, 300, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        mine = sorted((r["rank"], r["id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(d[i] - s) < 1e-9 for _, i, s in mine)
        hit, total = hit + len({m[1] for m in mine} & set(best)), total + 5
    assert hit / total >= 0.9
    # fifteen equal vectors: the others of smallest id come first
    assert [r["id"] for r in sorted((r for r in out if r["query_id"] == 200), key=lambda r: r["rank"])] == [201, 202, 203, 204, 205]
    assert not [r for r in out if r["query_id"] >= 900]
    assert nearest(frame(spark, odd[:1]), F.lit(True)).count() == 0
    assert nearest(frame(spark, data[:3]), F.col("vec_id") == 0, k=10).count() == 2


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Recall where the kd-tree deals the vectors into several cells and queries visit more than their own."""
    import rasterloom.llm.ann as m
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "CELL_ROWS", 64)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((40, 24)) * 2)[rng.integers(0, 40, 900)] + rng.standard_normal((900, 24))
    out = nearest(frame(spark, list(enumerate(x.astype(np.float32)))), F.col("vec_id") % 20 == 0, k=10).collect()
    hit = 0
    for q in range(0, 900, 20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        best = [i for i in np.argsort(d, kind="stable") if i != q][:10]
        hit += len({r["id"] for r in out if r["query_id"] == q} & set(best))
    assert len(out) == 450 and hit / 450 >= 0.9


def test_tree_visits_the_cells_near_enough():
    import pyarrow as pa

    import rasterloom.llm.ann as m

    rng = np.random.default_rng(4)
    points = rng.standard_normal((500, 8))
    nodes, depth = m.split(points, 16, 64)
    cell = m.leaf_of(points, nodes, depth)
    cells = np.unique(cell)
    low, high = (np.array([f(points[cell == c], axis=0) for c in cells]) for f in (np.min, np.max))
    q, bound = rng.standard_normal((30, 8)), rng.uniform(0.1, 3, 30)
    lists = pa.array(q.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([-1] * 30, pa.int64()), lists, lists, pa.array(bound)], names=["id", "cell", "vec", "p", "bound"])
    found = {(i, c) for out in m._visit(m.boxes_by_level(low, high, cells, depth), 1.5)(iter([batch])) for i, c in zip(out.column("id").to_pylist(), out.column("cell").to_pylist())}
    near = m.box_distance(q, low, high) <= 1.5 * bound[:, None]
    assert found == {(i, cells[j]) for i, j in zip(*np.nonzero(near))}


def test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_keys_don_t_depend_on_the_rows_beside():
    from rasterloom.llm.vectors import bucket_keys, sketches, unit_rows

    u = unit_rows(np.random.default_rng(3).standard_normal((700, 48)))
    whole = bucket_keys(u, 7, 40, 13)
    for rows in ([0], [5, 699], list(range(100, 163))):
        assert (bucket_keys(u[rows], 7, 40, 13) == whole[rows]).all()
    assert sketches(u, 7).shape == (700, 2)


def test_no_link_of_a_sieved_pair_is_lost(spark):
    """Pairs at cosines just above the threshold, many of them, against all cosines."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((150, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.standard_normal((150, 48))
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.99, (150, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away]).astype(np.float32).astype(np.float64)
    got = {r["id"]: r["n_links"] for r in near_vectors(frame(spark, list(enumerate(x)))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[i] for i in range(300)] == want.tolist()


def test_rows_that_share_an_id_or_have_none(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a)]
    got = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, rows)).collect()), key=str)
    assert {g[2] for g in got if g[0] in (1, 2, 3)} == {1}
    assert [g for g in got if g[0] is None] == [(None, 0, None, False)]
    from pyspark.sql import functions as F

    out = nearest(frame(spark, [*rows, (3, b), (5, [0.9, 0.1, 0.0])]), F.col("vec_id") == 2, k=3).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])][:1] == [1]
    assert all(r["id"] not in (None, 2) for r in out)


def test_tables_and_directions():
    from rasterloom.llm.vectors import MISS, collision, plan

    rng = np.random.default_rng(1)
    for distance in (0.447, 1.414):
        gap = distance * rng.standard_normal(200_000)
        same = np.floor(rng.uniform(0, 1, gap.size) + gap / 2.5) == 0
        assert abs(same.mean() - collision(distance)) < 5e-3
    for n in (0, 100, 50_000, 50_000_000):
        tables, hashes = plan(n, 0.9)
        assert (1 - collision(np.sqrt(0.2)) ** hashes) ** tables <= MISS
    assert plan(50_000, 0.9) == (43, 13) and plan(50_000_000, 0.9) == (338, 26)
