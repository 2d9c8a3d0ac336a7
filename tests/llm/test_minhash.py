from lodestone.llm.components import connected_components
from lodestone.llm.minhash_tensor import minhash_clusters
from tests.llm.fixtures import docs, empty, rows, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(items, percent=85):
    sets = {i: shingles(t) for i, t in items}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def test_equals_brute_force_with_odd_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    near = [(200_000 + i, " ".join(w if (k * 7 + i) % 97 else f"new{i}" for k, w in enumerate(base * 6))) for i in range(40)]
    extra = [(i, t, "en", "s", 0, None, None, None, None) for i, t in near]
    frame = docs(spark).union(spark.createDataFrame(extra, docs(spark).schema))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_clusters(frame, crowd=7).collect()}
    assert got == brute([(r[0], r[1]) for r in [*rows(), *extra]])


def test_empty_table(spark):
    assert minhash_clusters(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_equal_and_null_ids(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi", "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince")
    rows = [(1, a), (1, b), (2, a), (3, a), (4, b), (5, b), (5, b), (None, a), (None, b)]
    out = {r.doc_id: r for r in minhash_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5]
    assert out[2].component_id == out[3].component_id and out[4].component_id == out[5].component_id
    # document 1 is one of its two texts, never both
    assert len({out[2].component_id, out[4].component_id}) == 2
    assert out[1].n_shingles == len(a.split()) - 4 and out[2].component_id == 1 or out[1].n_shingles == len(b.split()) - 4 and out[4].component_id == 1
