import numpy as np

from lodestone.llm.cross_polytope import hadamard, nearest
from lodestone.llm.pigeonhole_join import vector_clusters

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((8, 16)) for c in centres]).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 3, "z", 1) for i, r in enumerate(x)]
    rows += [(1000, rows[0][1], 0, None, None), (1001, None, 0, None, None), (1002, [0.0] * 16, 0, None, None), (1003, [float("nan")] * 16, 0, None, None), (1004, [1.0, None] + [0.0] * 14, 0, None, None), (1005, [1.0, 2.0], 0, None, None), (None, rows[1][1], 0, None, None)]
    good = {r[0]: np.array(r[1], float) for r in rows[: len(x) + 1]}
    return spark.createDataFrame(rows, SCHEMA), good


def test_links_equal_brute_force(spark):
    frame, good = table(spark)
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.array(ids)
    for _ in ids:
        root = np.array([min([root[k], *root[link[k]]]) for k in range(len(ids))])
    want = {i: (int(link[k].sum()), int(root[k])) for k, i in enumerate(ids)}
    want |= {i: (0, i) for i in (1001, 1002, 1003, 1004, 1005)}
    assert sum(n for n, _ in want.values()) > 50
    for crowd in (8192, 5):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_clusters(frame, crowd=crowd).collect()}
        assert got == want


def test_search_finds_the_nearest(spark):
    frame, good = table(spark)
    from pyspark.sql import functions as F

    got = nearest(frame, F.col("id") % 4 == 0, k=10).collect()
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    hits = total = 0
    for q in ids[ids % 4 == 0]:
        score = x @ good[q]
        order = [i for i in ids[np.lexsort((ids, -score))] if i != q][:10]
        found = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in found] == list(range(1, len(found) + 1))
        hits, total = hits + len({i for _, i in found} & set(order)), total + 10
    assert hits / total >= 0.9
    assert all(abs(r.score - good[r.query_id] @ good[r.vec_id]) < 1e-9 for r in got)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_empty_tables(spark):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], SCHEMA)
    assert vector_clusters(none).count() == 0
    assert nearest(none, F.lit(True)).count() == 0


def test_search_with_vectors_of_many_lengths(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    base = np.concatenate([c + 0.4 * rng.standard_normal((30, 64)) for c in centres])
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    n = len(base)
    lengths = {"one long": np.where(np.arange(n) == 7, 100.0, 1.0), "jitter": 1 + 1e-5 * rng.standard_normal(n), "lognormal": np.exp(0.3 * rng.standard_normal(n))}
    for name, length in lengths.items():
        x = base * length[:, None]
        frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in nearest(frame, F.col("id") % 20 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, n, 20):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(got[q] & set(np.argsort(-score, kind="stable")[:20].tolist()))
            assert len(got[q]) == 20, name
        assert hits / (20 * len(range(0, n, 20))) >= 0.9, name


def loaded(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    return t.column("vec_id").to_numpy(), np.asarray(t.column("embedding").combine_chunks().flatten(), float).reshape(len(t), -1)


def test_embeddings_are_searched_with_few_comparisons(spark):
    from lodestone.llm import cross_polytope as cp

    ids, x = loaded("sf0.1")
    got = {}
    for r in cp.op3_cross_polytope(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, queries = 0, np.flatnonzero(ids % 20 == 0)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / (20 * len(queries)) >= 0.9
    # distinct pairs that meet in a bucket, of all pairs of a query and another row
    u, axes = cp.unit(x), cp.width(len(x), 64)
    met = np.zeros((len(queries), len(x)), bool)
    for table in range(16):
        name, probed = cp.buckets(u, table, axes, 1)[:, 0], cp.buckets(u[queries], table, axes, 256)
        for i, p in enumerate(probed):
            met[i] |= np.isin(name, p)
    assert met.mean() < 0.3


def test_probes_are_the_best_buckets():
    from lodestone.llm import cross_polytope as cp

    x = cp.unit(np.random.default_rng(4).standard_normal((6, 8)))
    for axes, probes in (((8, 8), 20), ((8, 8, 2), 30), ((8, 1), 1000)):
        y = [cp.pseudo_rotation(x, 3 * 8 + i)[:, :a] for i, a in enumerate(axes)]
        total, name = np.zeros((len(x), 1)), np.zeros((1,), int)
        for z, a in zip(y, axes, strict=True):
            z = np.concatenate((z, -z), axis=1)
            total = (total[:, :, None] + z[:, None, :]).reshape(len(x), -1)
            name = (name[:, None] * 2 * a + np.arange(2 * a)).reshape(-1)
        got = cp.buckets(x, 3, axes, probes)
        for i in range(len(x)):
            # bucket b stands at place b; equal sums may come in any order
            assert np.array_equal(name, np.arange(len(name))) and len(set(got[i].tolist())) == len(got[i])
            assert np.allclose(total[i][got[i]], np.sort(total[i])[::-1][:probes])


def test_links_of_the_embeddings_equal_brute_force(spark):
    ids, x = loaded("sf0.01")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for cell_rows in (8192, 4):  # eight cells a block, or many
        got = {r.vec_id: r.n_links for r in vector_clusters(frame, cell_rows=cell_rows).collect()}
        assert got == dict(zip(ids.tolist(), link.sum(axis=1).tolist(), strict=True))
