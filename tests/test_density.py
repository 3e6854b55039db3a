"""Topics by density against plain versions: subspace, neighbours, forest, hierarchy, choice."""

import itertools
import math

import numpy as np
import pytest

from tidewater.operators import density

SF = "/root/testdata/sf0.01"


def clouds(seed=3, n=60, dims=5):
    """Rows around centres, some alone, some copied."""
    r = np.random.default_rng(seed)
    centres = [np.zeros(dims), np.r_[6.0, np.zeros(dims - 1)], np.r_[0.0, 7.0, np.zeros(dims - 2)], np.r_[6.5, 0.8, np.zeros(dims - 2)]]
    x = [c + r.normal(0, s, dims) for c, s in zip(centres, (0.5, 0.4, 0.8, 0.3)) for _ in range(n)] + [r.uniform(-15, 15, dims) for _ in range(15)]
    x += [x[5]] * 3 + [x[100]] * 30 + [np.full(dims, 20.0)] * 25
    return [v.tolist() for v in x]


def frame(spark, x):
    return spark.createDataFrame([(i, v, "other") for i, v in enumerate(x)], "id long, vector array<double>, weight string").repartition(3)


def test_axes_equal_numpy(spark):
    x = np.array(clouds()) @ np.diag([1, 3, 0.2, 5, 1])
    mean, axes = density.principal_axes(frame(spark, x.tolist() + [None]), "vector", 2)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert mean == pytest.approx(x.mean(0)) and np.abs(axes @ axes.T - np.eye(2)).max() < 1e-9
    assert np.abs(axes.T @ axes - vt[:2].T @ vt[:2]).max() < 1e-6
    got = {r.id: r.vector for r in density.reduced(frame(spark, x.tolist() + [None]), "id", "vector", 2).collect()}
    assert len(got) == len(x) and all(got[i] == pytest.approx((v - mean) @ axes.T) for i, v in enumerate(x))


def plain_points(x):
    ids = {}
    for i, v in enumerate(x):
        ids.setdefault(tuple(v), []).append(i)
    return {own[0]: (len(own), np.array(v)) for v, own in ids.items()}


def plain_near(p, k):
    return {a: sorted((math.sqrt(((v - u) ** 2).sum()), b, w) for b, (w, u) in p.items() if b != a)[:k] for a, (_, v) in p.items()}


def plain_edges(p, near, k):
    core = {}
    for a, (w, _) in p.items():
        n, core[a] = w, 0.0
        for d, _, m in near[a]:
            if n >= k:
                break
            n, core[a] = n + m, d
    return {(min(a, b), max(a, b)): max(d, core[a], core[b]) for a in p for d, b, _ in near[a]}


def plain_forest(edges):
    up = {}

    def top(c):
        while up.get(c, c) != c:
            c = up[c]
        return c

    out = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if top(a) != top(b):
            up[top(a)] = top(b)
            out.append((a, b, w))
    return out


def plain_labels(p, forest, least):
    """From the top: the heaviest edge goes; a side of fewer than ``least`` rows falls out, two larger ones are clusters of their own."""
    links = {}
    for a, b, w in forest:
        links.setdefault(a, {})[b] = w
        links.setdefault(b, {})[a] = w

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    rows = lambda s: sum(p[a][0] for a in s)
    order = sorted(forest, key=lambda e: (-e[2], -e[0], -e[1]))

    def grow(members, birth):
        """(stability, chosen clusters as point -> density) of the cluster that these points are at its birth."""
        members, left, children = set(members), {}, []
        for a, b, w in order:
            if a not in members or b not in links[a]:
                continue
            del links[a][b], links[b][a]
            one, two = reach(a) & members, reach(b) & members
            lam = 1 / max(w, density.NEAR)
            if rows(one) >= least and rows(two) >= least:
                children = [(one, lam), (two, lam)]
                break
            for side in (one, two):
                if rows(side) < least:
                    left |= {x: lam for x in side}
                    members -= side
        for x in members if not children else ():
            left[x] = 1 / density.NEAR
        total = sum(p[x][0] * (l - birth) for x, l in left.items()) + sum(rows(s) * (l - birth) for s, l in children)
        under = [grow(s, l) for s, l in children]
        best = sum(u[0] for u in under)
        return total, best, left, under

    def every(node):
        out = dict(node[2])
        for u in node[3]:
            out |= every(u)
        return out

    def worth(node):
        return max(node[0], sum(worth(u) for u in node[3]))

    def pick(node, root):
        if not root and node[0] >= sum(worth(u) for u in node[3]):
            return [every(node)]
        return [c for u in node[3] for c in pick(u, False)]

    tops = []
    for a in p:
        if not any(a in t for t in tops):
            tops.append(reach(a))
    tops = [t for t in tops if rows(t) >= least]
    nodes = [grow(t, 0.0) for t in tops]
    return [c for n in nodes for c in pick(n, len(nodes) == 1)]


def test_steps_equal_plain_versions(spark):
    x, k = clouds(), 4
    p = plain_points(x)
    given = density.stored(density.points(frame(spark, x), "id", "vector"))
    assert {r.id: r.weight for r in given.collect()} == {a: w for a, (w, _) in p.items()}
    near = density.stored(density.neighbours(given, 8))
    want = plain_near(p, 8)  # all points fit into a block or two: lists of several trees together are nearly all right
    got = {r.id: [(e.d, e.id, e.weight) for e in r.near] for r in near.collect()}
    right = sum(len({e[1] for e in got[a]} & {e[1] for e in want[a]}) for a in p) / sum(map(len, want.values()))
    assert right > 0.97 and all(v == sorted(v) and len(v) == 8 for v in got.values())
    edges = plain_edges(p, {a: got[a] for a in p}, k)
    mine = {(r.a, r.b): r.w for r in density.reachability(near, k).collect()}
    assert mine.keys() == edges.keys() and all(mine[e] == pytest.approx(edges[e]) for e in edges)
    forest = sorted(tuple(r) for r in density.spanning_forest(density.reachability(near, k)).collect())
    assert forest == sorted(plain_forest(mine))


@pytest.mark.parametrize("band", [1 << 20, 25])
def test_topics_equal_plain_version(spark, monkeypatch, band):
    """With every band of edges folded by itself too."""
    monkeypatch.setattr(density, "BAND", band)
    monkeypatch.setattr(density, "BLOCK", 1000)
    x, k, least = clouds(), 4, 20
    got = {r.id: (r.topic, r.topic_probability) for r in density.density_topics(frame(spark, [*x, None]), "id", "vector", least, k, dims=5).collect()}
    assert len(got) == len(x) + 1 and got[len(x)] == (-1, 0.0)
    low = {r.id: tuple(r.vector) for r in density.reduced(frame(spark, x), "id", "vector", 5).collect()}
    p = plain_points([low[i] for i in range(len(x))])
    clusters = plain_labels(p, plain_forest(plain_edges(p, plain_near(p, k + 4), k)), least)
    point = {v: min(j for j in low if low[j] == v) for v in set(low.values())}
    want = {}
    ranked = sorted(clusters, key=lambda c: -sum(p[a][0] for a in c))
    assert len(ranked) >= 4 and len({sum(p[a][0] for a in c) for c in ranked}) == len(ranked)
    for t, c in enumerate(ranked):
        for a, lam in c.items():
            want[a] = (t, lam / max(c.values()))
    for i in range(len(x)):
        t, prob = want.get(point[low[i]], (-1, 0.0))
        assert got[i][0] == t and got[i][1] == pytest.approx(prob)


def test_recall_of_neighbour_lists(spark, monkeypatch):
    """Nine of ten nearest neighbours are found, also where coarse cells, random cuts and parts are in play."""
    monkeypatch.setattr(density, "CELL", 256)
    monkeypatch.setattr(density, "SAMPLE", 512)
    monkeypatch.setattr(density, "BLOCK", 128)
    low = density.stored(density.reduced(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding", 16))
    given = density.stored(density.points(low, "vec_id", "vector"))
    got = {r.id: {e.id for e in r.near} for r in density.neighbours(given, 10).collect()}
    rows = given.collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.vector for r in rows])
    right = total = 0
    for i in range(0, len(ids), 7):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        best = set(ids[np.argsort(d, kind="stable")[:10]].tolist())
        right, total = right + len(best & got[ids[i]]), total + len(best)
    assert right / total >= 0.9


def test_a_family_of_copies_is_one_point(spark):
    x = [[1.0, 2.0]] * 5000 + [[1.0 + i / 100, 2.0] for i in range(1, 40)]
    got = [r.topic for r in density.density_topics(frame(spark, x), "id", "vector", 30, 5, dims=2).collect()]
    assert len(got) == 5039 and density.points(frame(spark, x), "id", "vector").count() == 40


def test_few_rows_and_none(spark):
    assert density.density_topics(frame(spark, []), "id", "vector").count() == 0
    got = density.density_topics(frame(spark, [[1.0, 2.0], None, [1.0, 2.5]]), "id", "vector").collect()
    assert sorted((r.id, r.topic) for r in got) == [(0, -1), (1, -1), (2, -1)]


def test_parents_have_numbers_of_their_own():
    names = {density._parent(a, b) for a, b in itertools.combinations(range(40), 2)}
    assert len(names) == 780 and all(n < 0 for n in names) and density._parent(3, 9) == density._parent(9, 3)
