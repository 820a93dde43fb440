"""Depth-first searches against a stack in plain Python, and what they write."""

import random

import pytest

from sieveworks.operators import graph, units


def stacked(lists, seed, depth, budget):
    """What a search with a stack visits, in order."""
    stack, seen = [(seed, 0)], []
    while stack and len(seen) < budget:
        at, deep = stack.pop(0)
        if at in seen:
            continue
        seen.append(at)
        if deep < depth:
            stack = [(to, deep + 1) for to in lists.get(at, [])] + stack
    return seen


def random_graph(k, nodes=14, edges=40):
    rng = random.Random(k)
    rows = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
    lists = {}
    for at, to in rows:
        lists.setdefault(at, []).append(to)
    return lists, [(at, to, place) for at, out in lists.items() for place, to in enumerate(out)]


@pytest.fixture
def written(monkeypatch):
    """Rows that searches write between rounds."""
    counts, write = [], graph.settled

    def settled(df):
        out = write(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", settled)
    return counts


@pytest.mark.parametrize(("k", "depth", "budget"), [(1, 5, 7), (2, 3, 4), (3, 2, 20), (4, 6, 1), (5, 0, 3)])
def test_budgeted_search_is_that_of_a_stack(spark, k, depth, budget):
    lists, rows = random_graph(k)
    seeds = spark.createDataFrame([(n,) for n in range(16)], "id bigint")
    found = {}
    for r in units.import_closure(seeds, spark.createDataFrame(rows, "path bigint, imported bigint, place int"), depth, budget).collect():
        found.setdefault(r.seed, {})[r.number] = r.path
    assert {s: [v[n] for n in sorted(v)] for s, v in found.items()} == {n: stacked(lists, n, depth, budget) for n in range(16)}


def test_budgeted_search_writes_a_row_for_each_seed(spark, written):
    """However much lies behind the budget: four levels of six imports each are 1,554 files behind the root."""
    edges = [(n, 6 * n + 1 + k) for n in range(259) for k in range(6)]
    found = units.import_closure(spark.createDataFrame([(0,)], "id int"), spark.createDataFrame(edges, "path int, imported int"), 4, 7).collect()
    assert [r.path for r in sorted(found, key=lambda r: r.number)] == [0, 1, 7, 43, 259, 260, 261]
    assert written[0] == 259 and max(written[1:]) == 1


@pytest.mark.parametrize(("k", "depth"), [(1, 5), (6, 3), (7, 1)])
def test_whole_search_is_that_of_a_stack(spark, k, depth):
    lists, rows = random_graph(k)
    steps = graph.steps_of(spark.createDataFrame(rows, "caller bigint, callee bigint, place int"))
    found = {n: [] for n in range(16)}
    for r in graph.depth_first(spark.createDataFrame([(n,) for n in range(16)], "id bigint"), steps, depth).collect():
        found[r.seed].append((r.path, r.id))
    assert {s: [s, *(i for _, i in sorted(v))] for s, v in found.items()} == {n: stacked(lists, n, depth, 10**6) for n in range(16)}


def test_seeds_whose_search_is_done_are_set_aside(spark, written):
    """Ninety seeds with one way each, and one whose way down is found anew four times."""
    rows = [(n, n + 1, 0) for n in range(1000, 1180, 2)] + [(0, 1, 1), (0, 2, 0), (2, 1, 1), (2, 3, 0), (3, 1, 1), (3, 4, 0), (4, 1, 0), (1, 5, 0), (5, 6, 0)]
    seeds = spark.createDataFrame([(0,)] + [(n,) for n in range(1000, 1180, 2)], "id bigint")
    found = graph.depth_first(seeds, graph.steps_of(spark.createDataFrame(rows, "caller bigint, callee bigint, place int")), 5)
    assert sorted((list(r.path), r.id) for r in found.where("seed = 0").collect()) == [([1], 2), ([1, 1], 3), ([1, 1, 1], 4), ([1, 1, 1, 1], 1), ([1, 1, 1, 1, 1], 5)]
    assert found.count() == 95 and written[-1] < 90
