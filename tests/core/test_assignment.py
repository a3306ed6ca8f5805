"""Assignments beside all assignments."""

import itertools
import random

import numpy as np
import pytest


def _best(cost, room):
    """(left out, total cost) of the best of all assignments."""
    return min((sum(j is None for j in pick), sum(cost[i][j] for i, j in enumerate(pick) if j is not None))
               for pick in itertools.product(*([None, *c] for c in cost)) if all(sum(j == p for j in pick) <= n for p, n in room.items()))


@pytest.mark.parametrize("seed", range(6))
def test_least_cost_equals_the_best_of_all(spark, seed):
    from perilmesh.operators.assignment import least_cost

    rng = random.Random(seed)
    cost = [{p: rng.randrange(4 if seed == 2 else 100) for p in "abcde" if rng.random() < 0.8} for _ in range(5)]
    room = {p: rng.choice([0, 1, 1, 2] if seed % 2 else [1]) for p in "abcde"}
    pairs = [(i, p, c) for i, row in enumerate(cost) for p, c in row.items()]
    got = least_cost(spark.createDataFrame(pairs, "who long, place string, cost long"), room, restage=2).collect()
    assert all(cost[r.who][r.place] == r.cost for r in got) and len({r.who for r in got}) == len(got)
    assert all(sum(r.place == p for r in got) <= n for p, n in room.items())
    assert (5 - len(got), sum(r.cost for r in got)) == _best(cost, room)


def test_a_chain_of_moves_beyond_greed(spark):
    """The last one has one place only, so that all others must move up by one."""
    from perilmesh.operators.assignment import least_cost

    n = 9
    pairs = [(i, i, 10 * i) for i in range(n)] + [(i, i + 1, 10 * i + 11) for i in range(n)] + [(n, 0, 5)]
    got = {r.who: r.place for r in least_cost(spark.createDataFrame(pairs, "who int, place int, cost int"), dict.fromkeys(range(n + 1), 1)).collect()}
    assert got == {n: 0} | {i: i + 1 for i in range(n)}
    assert least_cost(spark.createDataFrame(pairs, "who int, place int, cost int"), {}).count() == 0
    assert least_cost(spark.createDataFrame([], "who int, place int, cost int"), {1: 1}).count() == 0


def test_negative_cycles():
    from perilmesh.operators.assignment import _FAR, _negative_cycle

    for seed in range(200):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 7))
        w = np.where(rng.random((n, n)) < 0.6, rng.integers(-4, 10, (n, n)), _FAR)
        np.fill_diagonal(w, _FAR)
        have = any(sum(int(w[a, b]) for a, b in zip(c, c[1:] + c[:1])) < 0 for k in range(2, n + 1) for c in map(list, itertools.permutations(range(n), k)))
        cycle = _negative_cycle(w)
        assert (cycle is not None) == have
        if cycle:
            assert len(set(cycle)) == len(cycle) and sum(int(w[a, b]) for a, b in zip(cycle, cycle[1:] + cycle[:1])) < 0
