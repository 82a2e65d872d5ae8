"""Similarity in a graph with a hub against plain Python."""

import random

import pytest

from pairwright.operators import graph


def plain(pairs, category, edges):
    out = {}
    for a, b in pairs:
        direct = sorted((s, w) for x, y, w, s in edges if (x, y) == (a, b))
        two = sorted((s, q, w * v * 0.5) for x, y, w, s in edges if x == a for m, z, v, q in edges if m == y and z == b)
        if a == b:
            out[a, b] = 1.0
        elif a not in category or b not in category:
            out[a, b] = 0.0
        elif direct:
            out[a, b] = direct[0][1]
        elif two:
            out[a, b] = two[0][2]
        else:
            out[a, b] = 0.3 if category[a] == category[b] else 0.0
    return out


@pytest.mark.parametrize("light", [1000, 3])
def test_similarity_with_a_hub(spark, monkeypatch, light):
    """With ``light`` 3 the hub and others are heavy."""
    monkeypatch.setattr(graph, "LIGHT_DEGREE", light)
    draw = random.Random(2)
    names = [f"n{i}" for i in range(40)]
    category = {n: f"c{draw.randrange(12)}" for n in names}
    links = [("n0", n) for n in names[1:25]] + [tuple(draw.sample(names, 2)) for _ in range(40)]
    edges = [(a, b, draw.randrange(1, 9) / 8, i) for i, (a, b) in enumerate(links)]
    pairs = sorted({(draw.choice([*names, "gone"]), draw.choice(names)) for _ in range(300)})
    skills = spark.createDataFrame([(n, c) for n, c in category.items()], "id string, category string")
    rows = spark.createDataFrame([(a, b, "related_to", w, s) for a, b, w, s in edges], "src string, dst string, relation string, weight double, seq bigint")
    asked = spark.createDataFrame(pairs, "skill1 string, skill2 string")
    got = {(r.skill1, r.skill2): r.similarity for r in graph.skill_similarity(asked, skills, rows).collect()}
    assert got == pytest.approx(plain(pairs, category, edges))


def test_only_asked_pairs_of_matches(spark):
    skills = spark.createDataFrame([(n, "c") for n in "abcd"], "id string, category string")
    edges = spark.createDataFrame([("a", "b", "x", 0.9, 0), ("b", "c", "x", 0.9, 1), ("d", "c", "x", 0.8, 2)],
                                  "src string, dst string, relation string, weight double, seq bigint")
    matches = spark.createDataFrame([(["a", "d"], ["c", "d"]), (["a"], None), (None, ["b"])], "resume_skills array<string>, job_skills array<string>")
    got = [(r.skill1, r.skill2, round(r.similarity, 4)) for r in graph.match_similarities(matches, skills, edges).collect()]
    assert got == [("a", "c", 0.405)]


@pytest.mark.parametrize("limits", [((1024, 16), 2_000_000), ((8, 2), 60), ((8,), 0)])
def test_sizes_are_those_of_the_subgraphs(spark, monkeypatch, limits):
    """Counted in blocks, in smaller blocks, and row by row; more than 64 groups, loops, repeats, unknown nodes."""
    monkeypatch.setattr(graph, "GROUPS_PER_BLOCK", limits[0])
    monkeypatch.setattr(graph, "BLOCK_RELATIONS", limits[1])
    kinds, draw = ["requires", "alternative", "used_with"], random.Random(3)
    links = [(f"n{draw.randrange(90)}", f"n{draw.randrange(90)}", draw.choice(kinds), 0.5, i) for i in range(140)]
    relations = spark.createDataFrame(links + links[:5] + [("n1", None, "requires", 0.5, 9)], graph.RELATION_SCHEMA)
    skills = spark.createDataFrame([(f"n{i}", "c") for i in range(80)], "id string, category string")
    members = spark.createDataFrame(
        [(g, f"n{draw.randrange(95)}") for g in range(150) for _ in range(1 + g % 2)] + [(200, "gone"), (201, None)], "group_id long, node string")
    nodes, inside = graph.skill_subgraph(members, skills, relations)
    known = {r.id for r in skills.collect()}
    want = {g: [0, 0, 0] for g, n in {tuple(r) for r in members.collect()} if n is not None}
    for row in nodes.collect():
        want[row.group_id][0] += row.node is not None
    for row in inside.collect():
        want[row.group_id][1] += 1
        want[row.group_id][2] += (1 if row.relation == "requires" else 2) * (row.source in known and row.target in known)
    got = {r.group_id: [r.nodes, r.relations, r.ends] for r in graph.subgraph_sizes(members, skills, relations).collect()}
    assert got == want


def test_edges_of_similarity_are_made_once(spark):
    skills = spark.createDataFrame([(n, "c") for n in "abc"], "id string, category string")
    edges = spark.createDataFrame([("a", "b", 0.5, 0), ("b", "c", 0.5, 1)], "src string, dst string, weight double, seq bigint").where("src <> 'madeonce'")
    asked = spark.createDataFrame([("a", "c"), ("a", "b")], "skill1 string, skill2 string")
    found = graph.skill_similarity(asked, skills, edges)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "b", 0.5), ("a", "c", 0.125)]
    assert "madeonce" not in found._jdf.queryExecution().optimizedPlan().toString()


def _random_graph(spark, nodes=40, lines=160, hub=0):
    import random

    draw = random.Random(5)
    drawn = {(f"n{draw.randrange(nodes)}", f"n{draw.randrange(nodes)}") for _ in range(lines)}
    drawn |= {("n0", f"n{i}") for i in range(1, hub)} | {(f"n{i}", "n0") for i in range(1, hub, 2)}
    listed = [(a, b, "x", draw.randrange(1, 9) / 8, i) for i, (a, b) in enumerate(sorted(drawn)) if a != b]
    listed += [(a, b, "y", 0.5, i + 10_000) for a, b, _, _, i in listed[::7]] + [("n1", None, "x", 0.5, 99_999)]
    return listed, spark.createDataFrame(listed, "src string, dst string, relation string, weight double, seq long")


@pytest.mark.parametrize("depth", [1, 2])
def test_related_skills_part_by_part(spark, monkeypatch, depth):
    """Written in parts, with seeds and nodes of many neighbours: the same rows."""
    monkeypatch.setattr(graph, "WAVE_ROWS", 400 if depth == 1 else 1500, raising=True)
    monkeypatch.setattr(graph, "LIGHT_DEGREE", 6)
    listed, edges = _random_graph(spark, hub=20)
    best = {}
    for a, b, _, w, _ in listed:
        best[a, b] = max(w, best.get((a, b), 0))
    seeds = [f"n{i}" for i in range(45)]
    want, last = {}, {(s, s): 1.0 for s in seeds}
    for _ in range(depth + 1):
        step = {}
        for (s, n), w in last.items():
            for (a, b), v in best.items():
                if a == n and b is not None and b != s:
                    step[s, b] = max(w * v, step.get((s, b), 0))
        last = step
        want.update({k: max(w, want.get(k, 0)) for k, w in step.items()})
    asked = spark.createDataFrame([(s,) for s in [*seeds, "n1", None]], "seed string")
    found = graph.related_skills(asked, edges, depth).collect()
    assert len(found) == len(want) and {(r.seed, r.node): r.weight for r in found} == pytest.approx(want)
    assert "waves-" in str(graph.related_skills(asked, edges, depth).inputFiles())


@pytest.mark.parametrize("light", [1000, 6])
def test_similarities_part_by_part(spark, monkeypatch, light):
    monkeypatch.setattr(graph, "WAVE_ROWS", 1000, raising=True)
    monkeypatch.setattr(graph, "LIGHT_DEGREE", light)
    listed, edges = _random_graph(spark, hub=20)
    names = [f"n{i}" for i in range(42)]
    kinds = {n: f"c{int(n[1:]) % 3}" for n in names[:-1]}
    skills = spark.createDataFrame(list(kinds.items()), "id string, category string")

    def similarity(a, b):
        if a == b:
            return 1.0
        if a not in kinds or b not in kinds:
            return 0.0
        direct = [(s, w) for x, y, _, w, s in listed if (x, y) == (a, b)]
        if direct:
            return min(direct)[1]
        two = [((s, z), w * v * 0.5) for x, m, _, w, s in listed if x == a for p, y, _, v, z in listed if p == m and y == b]
        return min(two)[1] if two else 0.3 if kinds[a] == kinds[b] else 0.0

    want = {(a, b): similarity(a, b) for a in names for b in names}
    pairs = spark.createDataFrame([*want, *list(want)[::9], (None, "n1"), ("n1", None)], "skill1 string, skill2 string")
    got = {(r.skill1, r.skill2): r.similarity for r in graph.skill_similarity(pairs, skills, edges).collect()}
    assert got.pop((None, "n1")) == 0.0 and got.pop(("n1", None)) == 0.0
    assert got == pytest.approx(want)
    lists = [(names[:5], names[3:30]), (names[20:], names[:25]), (None, names), ([], names), (["n1", None], ["n2"])]
    matches = spark.createDataFrame(lists, "resume_skills array<string>, job_skills array<string>")
    asked = {(a, b) for x, y in lists for a in set(x or []) - set(y) for b in set(y) - set(x or []) if a}
    for above in (0.3, 0.1):
        found = graph.match_similarities(matches, skills, edges, above).collect()
        assert {(r.skill1, r.skill2): r.similarity for r in found} == pytest.approx({k: want[k] for k in asked if want[k] > above})


def test_unlike_skills_are_ruled_out_before_the_join(spark):
    from pairwright.operators.joins import similar_listed_skills

    pairs = spark.createDataFrame(
        [(1, ["a", "b", "c"], ["c", "d", "e"]), (1, ["a"], ["d"]), (2, ["x"] * 2, ["y"]), (3, None, ["y"]), (None, ["a", None], ["e"]), (4, ["d"], ["a"])],
        "k long, mine array<string>, other array<string>")
    known = spark.createDataFrame([("a", "d", 0.5), ("b", "e", 0.25), ("b", "e", 0.75), ("c", "d", 1.0), ("x", "z", 1.0)], "skill1 string, skill2 string, similarity double")
    found = similar_listed_skills(pairs, ["k"], "mine", "other", known)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "a", "d", 0.5), (1, "a", "d", 0.5), (1, "b", "e", 0.25), (1, "b", "e", 0.75)]
