import numpy as np
import pytest
from pyspark.sql import functions as F

from redbuild.operators import dedup as D
from redbuild.operators import density as Y


def plain_density(points, weights, least, epsilon):
    """Cuts a group at each distance from the greatest down; (points -> label or None)."""
    ids = sorted(points)
    near = {(i, j): float(np.sqrt(np.round(np.sum(np.subtract(points[i], points[j]) ** 2), 9))) for i in ids for j in ids if i != j}

    def parts(members, below):
        left, out = set(members), []
        while left:
            todo = [left.pop()]
            part = set(todo)
            while todo:
                x = todo.pop()
                for y in [y for y in left if near[x, y] < below]:
                    left.discard(y)
                    part.add(y)
                    todo.append(y)
            out.append(part)
        return out

    clusters = {0: {"parent": None, "born": None, "stability": 0.0, "points": set(ids)}}

    def walk(members, cluster, cuts):
        density = lambda d: 1 / d - (1 / clusters[cluster]["born"] if cluster else 0.0)
        weight = lambda part: sum(weights[i] for i in part)
        for at, d in enumerate(cuts):
            if d == 0:
                break
            found = parts(members, d)
            if len(found) == 1:
                continue
            large = [p for p in found if weight(p) >= least]
            for p in found:
                if not (len(large) == 1 and p is large[0]):
                    clusters[cluster]["stability"] += weight(p) * density(d)
            if len(large) == 1:
                members = large[0]
                continue
            for p in large:
                name = len(clusters)
                clusters[name] = {"parent": cluster, "born": d, "stability": 0.0, "points": p}
                walk(p, name, cuts[at + 1:])
            return
        if cluster:
            clusters[cluster]["stability"] = float("inf")

    walk(set(ids), 0, sorted(set(near.values()), reverse=True))
    children = {c: [k for k, v in clusters.items() if v["parent"] == c] for c in clusters}
    picked = {}

    def below(c):
        return [x for k in children[c] for x in [k, *below(k)]]

    total = {}
    for c in sorted(clusters, reverse=True):
        if c:
            inside = sum(total[k] for k in children[c])
            picked[c] = not (children[c] and inside > clusters[c]["stability"])
            total[c] = clusters[c]["stability"] if picked[c] else inside
    for c in sorted(clusters):
        if picked.get(c):
            for k in below(c):
                picked[k] = False
    final = set()
    for c in [c for c in picked if picked[c]]:
        if clusters[c]["born"] < epsilon:
            while clusters[c]["parent"] != 0:
                c = clusters[c]["parent"]
                if clusters[c]["born"] > epsilon:
                    break
        final.add(c)
    return {i: next((min(clusters[c]["points"]) for c in sorted(final) if i in clusters[c]["points"]), None) for i in ids}


def clouds(seed, groups=12, most=16):
    """Groups of nested tight and loose clumps, copies, equal distances and loners, as unit vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        vectors = []
        if g % 4 == 3:  # corners: many equal distances
            vectors = [np.eye(5)[rng.integers(5)] for _ in range(rng.integers(1, most))]
        while len(vectors) < rng.integers(1, most):
            centre = rng.normal(size=5)
            for _ in range(rng.integers(1, 6)):
                vectors.append(centre + rng.normal(size=5) * rng.choice([0.0, 0.005, 0.03, 0.2]))
        rows += [(g, g * 1000 + i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(vectors)]
    return rows


def by_group(points):
    groups = {}
    for r in points:
        groups.setdefault(r["g"], {})[r["id"]] = r
    return groups


@pytest.mark.parametrize("epsilon", [0.1, 0.6])
def test_trees_equal_the_plain_cut(epsilon):
    met = set()
    for seed in range(8):
        for g, rows in by_group([{"g": g, "id": i, "vec": v} for g, i, v in clouds(seed)]).items():
            distinct = {}
            for i, r in sorted(rows.items()):
                distinct.setdefault(tuple(np.round(r["vec"], 12)), []).append(i)
            ids = sorted(c[0] for c in distinct.values())
            weights = {c[0]: len(c) for c in distinct.values()}
            for least in (2, 3):
                a, b, square = Y.spanning_links(np.array([rows[i]["vec"] for i in ids]))
                a, b = np.minimum(a, b), np.maximum(a, b)
                merger = Y.Merger({k: Y.Level((k, k), None, weights[i]) for k, i in enumerate(ids)}, least)
                for k in np.lexsort((b, a, square)):
                    merger.merge(int(a[k]), int(b[k]), int(a[k]), int(b[k]), float(np.sqrt(square[k])))
                found = Y.chosen_nodes(merger.links, epsilon, [(k, k) for k in range(len(ids))])
                first = {}
                for i, c in zip(ids, found):
                    first.setdefault(c, i)
                got = {i: None if c is None else first[c] for i, c in zip(ids, found)}
                assert got == plain_density({i: rows[i]["vec"] for i in ids}, weights, least, epsilon), (seed, g, least)
                met.update(x is None for x in got.values())
    assert met == {True, False}


@pytest.mark.parametrize("limits", [{}, {"small": 5, "band_links": 30, "block_rows": 8}])
def test_groups_in_one_task_and_in_bands_of_links(spark, limits):
    rows = clouds(7, groups=2, most=30)
    points = spark.createDataFrame(rows, "g int, id long, vec array<double>")
    found = D.density_clusters(points, **limits).collect()
    loose = 0
    for group in by_group(found).values():
        want = plain_density({i: r["vec"] for i, r in group.items()}, {i: r["copies"] for i, r in group.items()}, 2, 0.1)
        assert {i: r["label"] for i, r in group.items()} == {i: i if c is None else c for i, c in want.items()}
        for i, c in want.items():
            assert group[i]["members"] == (1 if c is None else sum(group[j]["copies"] for j in want if want[j] == c))
            loose += c not in (None, i) and np.linalg.norm(np.subtract(group[i]["vec"], group[c]["vec"])) > 0.1
    assert loose


def test_odd_groups(spark):
    rows = [
        (0, 1, [1.0, 0.0]),  # alone
        (1, 2, [0.0, 1.0]), (1, 3, [0.0, 1.0]),  # only copies: the whole group is no cluster
        (2, 4, [float("nan"), 0.0]), (2, 5, [1.0, 0.0]), (2, 6, [1.0, 0.0]), (2, 7, [0.0, 1.0]), (2, 8, [0.0, 1.0]), (2, 9, [0.0, 0.0]),
    ]
    points = spark.createDataFrame(rows, "g int, id long, vec array<double>")
    got = {(r["g"], r["id"]): (r["label"], r["members"]) for r in D.density_clusters(points).collect()}
    assert got == {(0, 1): (1, 1), (1, 2): (2, 1), (2, 4): (4, 1), (2, 5): (5, 2), (2, 7): (7, 2), (2, 9): (9, 1)}
    assert D.density_clusters(points.limit(0)).count() == 0
    kept = {(r["g"], r["id"], r["kind"]) for r in D.representatives(points.filter("id <> 4"), clustering=D.density_clusters).collect()}
    assert kept == {(0, 1, "noise"), (1, 2, "noise"), (2, 5, "cluster"), (2, 7, "cluster"), (2, 9, "noise")}


def plain_tree(vectors):
    """Squared lengths of a minimum spanning tree."""
    square = np.round(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2), 9)
    best, inside, out = square[0].copy(), {0}, []
    while len(inside) < len(vectors):
        at = min((i for i in range(len(vectors)) if i not in inside), key=lambda i: best[i])
        inside.add(at)
        out.append(best[at])
        best = np.minimum(best, square[at])
    return sorted(out)


def odd_vectors(kind, n=230):
    rng = np.random.default_rng(5)
    if kind == "corners":  # all distances are equal
        return np.eye(n)
    if kind == "grid":  # few different distances, equal vectors
        return rng.integers(0, 3, size=(n, 4)).astype(float)
    if kind == "clumps":  # more points than a point has links, far from others
        return rng.normal(size=(n // 40, 6)).repeat(40, axis=0) + rng.normal(size=(n // 40 * 40, 6)) * 1e-3
    if kind == "long":  # beyond single precision
        return rng.normal(size=(n, 5)) * 1e20
    return rng.normal(size=(n, 16))


@pytest.mark.parametrize("kind", ["corners", "grid", "clumps", "long", "cloud"])
def test_links_are_a_minimum_spanning_tree(kind):
    vectors = odd_vectors(kind)
    a, b, square = Y.spanning_links(vectors)
    assert (a < b).all() and len(np.unique(Y.N.joined(np.arange(len(vectors)), a, b))) == 1
    assert np.allclose(sorted(square), plain_tree(vectors), rtol=1e-9, atol=2e-9)


def test_only_a_group_with_too_many_links_goes_through_in_bands(spark, monkeypatch):
    rows = clouds(7, groups=2, most=30)
    points = spark.createDataFrame(rows, "g int, id long, vec array<double>")
    monkeypatch.setattr(Y, "_merged", lambda *a: pytest.fail("cut into bands"))
    found = D.density_clusters(points, small=5, block_rows=8).collect()
    for group in by_group(found).values():
        want = plain_density({i: r["vec"] for i, r in group.items()}, {i: r["copies"] for i, r in group.items()}, 2, 0.1)
        assert {i: r["label"] for i, r in group.items()} == {i: i if c is None else c for i, c in want.items()}


@pytest.mark.parametrize("limits", [{}, {"known_rows": 400}])
def test_a_large_group_takes_few_passes_over_its_vectors(spark, monkeypatch, limits):
    passes, over = [], Y.N.over_pieces
    monkeypatch.setattr(Y.N, "over_pieces", lambda *a: passes.append(1) or over(*a))
    groups = {g: np.pad(v, ((0, 0), (0, 16 - v.shape[1]))) for g, v in enumerate(map(odd_vectors, ("cloud", "clumps", "grid")))}
    rows = [(g, f"{i:03}", [float(x) for x in v]) for g, vectors in groups.items() for i, v in enumerate(vectors)]
    found = Y.spanning_forest(spark.createDataFrame(rows, "g int, id string, vec array<double>"), block_rows=90, **limits).collect()
    assert 1 < len(passes) <= 5
    for g, vectors in groups.items():
        own = [r for r in found if r["g"] == g]
        ends = np.array([[int(r["a"]), int(r["b"])] for r in own])
        assert len(np.unique(Y.N.joined(np.arange(len(vectors)), ends[:, 0], ends[:, 1]))) == 1
        assert np.allclose(sorted(r["square"] for r in own), plain_tree(vectors), atol=2e-9)
