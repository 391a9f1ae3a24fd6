import numpy as np

from tidewatch.llm import components, vectors


def plain(rows, cosine=vectors.COSINE, kind=np.float32):
    ok = [i for i, (_, e, lab) in enumerate(rows) if lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, root = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[k][1], kind).astype(float) for k in (i, j))
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0), links[i], least.get(find(i)) if i in ok else r[0]) for i, r in enumerate(rows))


def cloud():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(16)
        rows += [[len(rows) + i, (centre + rng.standard_normal(16) * 0.05 * (i % 5)).tolist(), k % 3] for i in range(14)]
    chain = [[1000 + i, [float(np.cos(i * 0.19)), float(np.sin(i * 0.19)), 0.0], 7] for i in range(12)]
    odd = [[2000, None, 1], [2001, [], 1], [2002, [0.0, 0.0], 1], [2003, [1.0, None], 1], [2004, [float("nan"), 1.0], 1], [2005, [float("inf"), 1.0], 1], [2006, rows[0][1], None], [None, rows[0][1], 0], [None, [9.0, 9.0], 0], [2007, rows[3][1], 0], [2007, rows[3][1], 0]]
    rng.shuffle(rows)
    return rows + chain + odd


def test_links_and_components(spark, monkeypatch):
    rows = cloud()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain(rows)
    for home, most in ((1024, 4096), (3, 7)):  # the second deals every cell out in pieces
        monkeypatch.setattr(vectors, "HOME", home)
        monkeypatch.setattr(vectors, "ALL", most)
        got = vectors.near_duplicates(df).collect()
        assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(df.where("1 = 0")).collect() == []


def test_double_vectors_stay_double(spark):
    """A cosine below the threshold by less than single precision tells."""
    turned = lambda angle: [float(np.cos(angle)), float(np.sin(angle)), 0.0, 0.0]
    below, above = np.arccos(vectors.COSINE - 3e-9), np.arccos(vectors.COSINE + 3e-9)
    rows = [(0, turned(0.0), 1), (1, turned(below), 1), (2, turned(0.0), 2), (3, turned(above), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = vectors.near_duplicates(df).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in got) == plain(rows, kind=float)
    assert {r.vec_id: r.n_links for r in got} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_many_equal_rows(spark, monkeypatch):
    """100,000 equal vectors and null ids: one class, whose rows stay where they are."""
    hot = spark.range(100_000).selectExpr("IF(id % 2 = 0, id, NULL) AS vec_id", "array(1.0F, 2.0F) AS embedding", "1 AS label", "'x' AS cls", "id AS n")
    rest = spark.createDataFrame([(200_000, [1.0, 2.01], 1, "y", 3), (200_001, [5.0, -1.0], 1, "z", 4)], hot.schema)
    r = vectors.near_duplicates(hot.unionByName(rest)).selectExpr("count(*) AS rows", "sum(n_links) AS links", "count_if(component_id = 0) AS one").first()
    assert (r.rows, r.links, r.one) == (100_002, 100_001 * 100_000, 100_001)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (301, 300), (302, 301)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 301: 300, 302: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_any_size(spark):
    """Squares that leave the range of doubles: links by cosine all the same."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 0.0]), (4, [1e-200, 1e-202]), (5, [5e-324, 0.0]), (6, [1.7e308, 0.0]), (7, [0.0, 1e-310])]
    df = spark.createDataFrame([(i, 1, v) for i, v in rows], "vec_id long, label long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 3), 4: (3, 3), 5: (3, 3), 6: (3, 3), 7: (0, 7)}
