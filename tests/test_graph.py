from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluate, graph, retrieval, vectors
from graphloom.operators.components import connected_components


def pairs(spark, rows, schema="src long, dst long"):
    return spark.createDataFrame(rows, schema)


def test_components_match_union_find(spark):
    rng = random.Random(5)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(pairs(spark, e)).collect()}
    assert got == {x: top(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(pairs(spark, [])).count() == 0


def test_linking_twice_adds(spark):
    e = graph.assemble(graph.both_ways(pairs(spark, [("a", "b")], "a string, b string")), graph.both_ways(pairs(spark, [("a", "b")], "a string, b string"), w=0.5))
    assert {(r["src"], r["dst"]): r["w"] for r in e.collect()} == {("a", "b"): 1.5, ("b", "a"): 1.5}


def test_ppr_keeps_mass(spark):
    e = graph.both_ways(pairs(spark, [(1, 2), (2, 3), (3, 4), (4, 1), (2, 4)], "a long, b long"))
    seeds = spark.createDataFrame([("q", 1), ("q", 1), ("r", 3)], "qid string, node_id long")
    found = graph.shallow_ppr(e, seeds).collect()
    assert not {(r["qid"], r["node_id"]) for r in found} & {("q", 1), ("r", 3)}
    # All mass: one seed each, of which the part that is left at the seed isn't shown.
    assert 0.3 < sum(r["pi"] for r in found if r["qid"] == "q") < 1.0


def test_mass_cut_keeps_ties_with_the_best(spark):
    s = spark.createDataFrame([("q", i, 0.4) for i in range(3)] + [("q", 9, 0.1)], "qid string, node_id long, pi double")
    assert sorted(r["node_id"] for r in graph.mass_cut(s).collect()) == [0, 1, 2]


def test_shortest_paths(spark):
    e = graph.both_ways(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.25)], "a string, b string, w double"), w=F.col("w"))
    p = {r["node_id"]: (r["dist"], r["path"]) for r in graph.shortest_paths(e, spark.createDataFrame([("a",)], "source string")).collect()}
    assert p["c"] == (2.0, ["a", "b", "c"])


def test_shortest_paths_of_many_steps(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 4.0) for i in range(12)]
    e = graph.both_ways(spark.createDataFrame([*chain, ("n00", "n12", 0.25)], "a string, b string, w double"), w=F.col("w"))
    start = spark.createDataFrame([("n00",)], "source string")
    p = {r["node_id"]: (r["dist"], r["path"]) for r in graph.shortest_paths(e.filter("w > 1"), start).collect()}
    assert p == {f"n{i:02d}": (0.25 * i, [f"n{j:02d}" for j in range(i + 1)]) for i in range(13)}
    # The detour of twelve heavy edges costs 3, the one light edge 4.
    p = {r["node_id"]: (r["dist"], r["path"]) for r in graph.shortest_paths(e, start).collect()}
    assert p["n12"] == (3.0, [f"n{j:02d}" for j in range(13)])
    with pytest.raises(RuntimeError):
        graph.shortest_paths(e, start, most_rounds=5)


def test_entity_nodes_in_order_of_appearance(spark):
    m = spark.createDataFrame([("03", "b"), ("01", " C "), ("02", "A"), ("04", "c")], "place string, name string")
    g = spark.createDataFrame([("A", "A"), ("B", "A")], "name string, grp string")
    got = {r["grp"]: (r["node_id"], r["names"]) for r in graph.entity_nodes(m, g).collect()}
    assert got == {"C": ("N000000", ["C"]), "A": ("N000001", ["A", "B"])}


def test_orphans_meet_all_entities(spark):
    rel = spark.createDataFrame([("u1", "r1", "Ann met bob"), ("u2", "r2", "the Big House")], "unit string, r_id string, text string")
    ent = spark.createDataFrame([("u1", "n1", "ANN"), ("u1", "n2", "BIG HOUSE"), ("u1", "n3", "HOUSE BOAT")], "unit string, node_id string, alias string")
    near = graph.relation_entities(rel, ent)
    assert [tuple(r) for r in near.collect()] == [("r1", "n1")]
    assert [tuple(r) for r in graph.orphan_relations(rel, near, ent).collect()] == [("r2", "n2")]


def test_cliques_and_merging():
    near = {"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b", "d"}, "d": {"c"}}
    assert sorted(sorted(c) for c in graph.cliques_of(near, set(near), set())) == [["a", "b", "c"], ["c", "d"]]
    assert sorted(sorted(c) for c in graph.cliques_of(near, {"a", "b", "d"}, {"c"})) == []
    assert graph.merged_lists([["a", "b"], ["b", "c"], ["c", "d"]], most=3) == [["a", "b", "c"], ["c", "d"]]


def test_cliques_of_random_graphs(spark):
    import random

    for seed, n, p in ((1, 14, 0.5), (2, 30, 0.2)):
        rng = random.Random(seed)
        e = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p] + [(0, 0), (3, 3)]
        near = {a: {x for q in e for x in q if a in q} - {a} for a in range(n)}
        want, todo = set(), [((a,), near[a]) for a in range(n) if near[a]]
        while todo:
            c, both = todo.pop()
            if not both:
                want.add(tuple(str(x) for x in sorted(c)))
            todo += [((*c, x), both & near[x]) for x in both]
        assert sorted(tuple(r["clique"]) for r in graph.maximal_cliques(pairs(spark, e, "a int, b int")).collect()) == sorted(want)


def test_merged_lists_by_hand():
    def plain(lists, most):
        sets, again = [set(x) for x in lists], True
        while again:
            again, out = False, []
            while sets:
                now, rest = sets[0], []
                for s in sets[1:]:
                    if now & s and len(now | s) <= most:
                        now, again = now | s, True
                    else:
                        rest.append(s)
                out.append(now)
                sets = rest
            sets = out
        return sorted(sorted(s) for s in sets)

    import random

    rng = random.Random(4)
    for _ in range(300):
        lists = [rng.sample("abcdefghijkl", rng.randint(1, 4)) for _ in range(rng.randint(0, 9))]
        most = rng.randint(2, 8)
        assert graph.merged_lists(lists, most) == plain(lists, most)


def test_resolution_end_to_end(spark):
    from graphloom.functions import models
    from graphloom.operators import resolution

    small = [("A x", "A y"), ("A y", "A z")]
    big = [(f"{a} n{i}", f"{b} n{j}") for a, i in (("K", 1), ("K", 2), ("L", 3), ("L", 4), ("M", 5), ("M", 6), ("M", 7)) for b, j in (("K", 1), ("K", 2), ("L", 3), ("L", 4), ("M", 5), ("M", 6), ("M", 7)) if i < j and j - i <= 2]
    huge = [(f"Z{i:02d}", f"Z{j:02d}") for i in range(22) for j in range(i + 1, 22)]
    got = {tuple(r) for r in resolution.resolve(pairs(spark, small + big + huge, "a string, b string"), lambda: models.stand_in_match).collect()}
    # The small component stays; the chain is one list, divided by first letters; the clique of 22 names is given up.
    assert got == {*small, ("K n1", "K n2"), ("L n3", "L n4"), ("M n5", "M n6"), ("M n5", "M n7"), ("M n6", "M n7")}
    silent = resolution.resolve(pairs(spark, big, "a string, b string"), lambda: lambda p: ("[]", 1), retry=models.Retry(attempts=2))
    assert silent.count() == 21


def test_attributes_need_an_entity_and_a_summary(spark):
    nodes = spark.createDataFrame([("N1", "N"), ("T1", "T")], "node_id string, node_type string")
    made = lambda *rows: graph.attribute_nodes(nodes, spark.createDataFrame(list(rows), "entity_id string, summary string"))[0].collect()
    assert [tuple(r) for r in made(("N1", "s"))] == [("N1:A000", "A", "s", "N1")]
    for bad in (("T1", "s"), ("N1", " \n"), ("N2", "s")):
        with pytest.raises(Exception, match="no summary of an entity"):
            made(bad)


def test_communities_beat_spread_labels(spark):
    import random

    rng = random.Random(5)
    e = {(min(a, b), max(a, b)) for a in range(60) for b in (rng.sample(range(a // 12 * 12, a // 12 * 12 + 12), 4) + [rng.randrange(60)]) if a != b}
    edges = graph.both_ways(pairs(spark, sorted(e), "a long, b long"))
    found = graph.modularity(edges, graph.communities(edges))
    assert found >= graph.modularity(edges, graph.spread_labels(edges)) - 1e-9
    assert found > 0.4


def test_paths_from_all_where_no_entries(spark):
    edges = graph.both_ways(pairs(spark, [(1, 2), (2, 3)], "a long, b long"))
    none = spark.createDataFrame([], "node_id long")
    assert graph.paths_from(edges, none).count() == 9
    assert graph.paths_from(edges, none.unionByName(spark.createDataFrame([(1,)], "node_id long"))).count() == 3


def test_probed_neighbours_are_mostly_found(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (20, 12))[rng.integers(0, 20, 800)] + rng.normal(0, 0.25, (800, 12))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    q, i = v.withColumnRenamed("id", "src"), v.withColumnRenamed("id", "dst")
    exact = {(r["src"], r["dst"]) for r in vectors.top_k(q, i, 10, "src", "dst", drop_self=True).collect()}
    found = vectors.probed_top_k(q, i, 10, "src", "dst", drop_self=True).collect()
    assert len(found) == len(exact)
    assert len({(r["src"], r["dst"]) for r in found} & exact) >= 0.9 * len(exact)


def test_centres_too_large_to_send(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "id long, embedding array<double>")
    c = spark.createDataFrame([(i, [float(i), 2.0 - i, 0.5]) for i in range(4)], "cluster int, centre array<double>")
    few = sorted(tuple(r) for r in vectors.nearest_centres(v, c, 2).collect())
    monkeypatch.setattr(vectors, "MOST_SENT", 0)
    assert sorted(tuple(r) for r in vectors.nearest_centres(v, c, 2).collect()) == few


def test_communities_divide_all_nodes(spark):
    e = [(a, b) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10)]
    edges = graph.both_ways(pairs(spark, e, "a long, b long"))
    parts = graph.communities(edges)
    assert parts.count() == 10
    assert graph.modularity(edges, parts) > 0.3


def test_top_k_ties_go_to_the_smaller(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "id long, embedding array<double>")
    got = vectors.self_neighbours(v, 2).filter("src = 3").orderBy("rank").collect()
    assert [r["dst"] for r in got] == [0, 1]


def test_merged_contexts(spark):
    main = spark.createDataFrame([("q", 1, "a", 0.6), ("q", 2, "b", 0.4)], "qid string, pos int, node_id string, score double")
    sub = spark.createDataFrame([("q", 0, 1, "a", 0.9), ("q", 1, 1, "c", 0.6)], "qid string, sub int, pos int, node_id string, score double")
    got = [(r["node_id"], r["score"], r["rank"]) for r in retrieval.merged_contexts(main, sub).orderBy("rank").collect()]
    assert got == [("a", 0.9, 1), ("c", 0.6, 2)]


def test_metrics(spark):
    r = spark.range(1).select(evaluate.f_beta(F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("f"), evaluate.answer_accuracy(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("a")).first()
    assert r["f"] == pytest.approx(0.4)
    assert r["a"] == pytest.approx(0.75)
    att = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "qid string, verdict int")
    ans = spark.createDataFrame([("a", "x", "c"), ("b", "x", "c"), ("c", "x", "c"), ("d", " ", "c"), ("e", "x", "")], "qid string, answer string, context string")
    assert {r["qid"]: r["context_recall"] for r in evaluate.context_recall(att, ans).collect()} == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 0}
