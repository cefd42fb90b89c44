import pytest

from tidemark.plans.compaction import MB, Leveled, NoCompaction, SimpleLeveled, Task, Tiered, apply, is_bottom, output_files, planner
from tidemark.sources.runs import Run, overlapping, prune
from tidemark.functions.bounds import UNBOUNDED, excluded, included


def run(n, level, lo=0, hi=9, size=MB, t0=1, t1=9):
    return Run(str(n), f"runs/{n}", level, n, (lo,), (hi,), t0, t1, 10, size, False)


def ids(runs):
    return [int(r.id) for r in runs]


def test_no_task():
    assert NoCompaction().plan([run(i, 0) for i in range(10)]) is None


def test_leveled_takes_all_of_level_0_and_what_overlaps():
    state = [*(run(i, 0, 0, 50) for i in range(1, 6)), run(6, 1, 40, 60), run(7, 1, 70, 90)]
    task = Leveled().plan(state)
    assert ids(task.upper) == [1, 2, 3, 4, 5] and ids(task.lower) == [6] and task.target == 1
    assert Leveled().plan(state[:3]) is None


def test_leveled_moves_the_surplus_of_a_level():
    state = [run(i, 1, 10 * i, 10 * i + 5, 4 * MB) for i in range(5)] + [run(9, 2, 0, 12)]
    task = Leveled().plan(state)
    assert ids(task.upper) == [0, 1, 2] and ids(task.lower) == [9] and task.target == 2


def test_simple_leveled():
    state = [*(run(i, 0) for i in range(1, 5)), run(9, 1), run(10, 1)]
    task = SimpleLeveled().plan(state)
    assert ids(task.upper) == [1, 2, 3, 4] and ids(task.lower) == [9, 10]
    assert SimpleLeveled(level0_runs=None, level0_bytes=3 * MB).plan(state).target == 1
    assert SimpleLeveled(level0_runs=None).plan(state) is None
    task = SimpleLeveled().plan([run(1, 1, size=10 * MB), run(2, 2, size=4 * MB)])
    assert ids(task.inputs) == [1, 2] and task.target == 2
    assert SimpleLeveled().plan([run(1, 1, size=10 * MB), run(2, 2, size=5 * MB)]) is None


def test_tiered():
    tiers = [run(i, i) for i in range(1, 7)]
    task = Tiered().plan(tiers)
    assert set(ids(task.inputs)) == {1, 2, 3, 4, 5, 6} and task.target == 1
    grown = [run(1, 1, size=100 * MB), *(run(i, i) for i in range(2, 6)), run(6, 6)]
    task = Tiered().plan(grown)  # the oldest tier is large: by size ratio only the newer ones
    assert set(ids(task.inputs)) == {2, 3, 4, 5, 6} and task.target == 2
    assert Tiered().plan(tiers[:5]) is None
    assert Tiered.new_tier(tiers) == 7 and Tiered.new_tier([]) == 1


def test_apply():
    state = [*(run(i, 0) for i in range(8, 0, -1)), run(9, 1), run(10, 1)]
    task = Task(tuple(r for r in state if r.level == 0 and int(r.id) <= 5), tuple(r for r in state if r.level == 1), 1)
    after = apply(state, task, [run(11, 1, 20, 29), run(12, 1, 0, 9), run(13, 1, 40, 49)])
    assert ids(r for r in after if r.level == 0) == [8, 7, 6]
    assert ids(r for r in after if r.level == 1) == [12, 11, 13]
    untouched = apply([run(1, 0), run(4, 1), run(6, 2)], Task((run(1, 0),), (run(4, 1),), 1), [run(8, 1)])
    assert ids(untouched) == [6, 8]


def test_bottom_only_if_nothing_older_lies_outside():
    state = [run(1, 0, t0=5), run(2, 1, t0=1), run(3, 2, 100, 200, t0=1)]
    assert not is_bottom(state, Task((state[0],), (), 1), 9)
    assert is_bottom(state, Task(tuple(state[:2]), (), 1), 9)
    assert is_bottom([run(1, 1, t0=1), run(2, 0, t0=10)], Task((run(1, 1, t0=1),), (), 1), 9)


def test_pruning_and_overlap():
    state = [run(1, 1, 0, 9), run(2, 1, 10, 19), run(3, 1, 20, 29, t0=50)]
    assert ids(prune(state, included(9), excluded(20))) == [1, 2]
    assert ids(prune(state, excluded(9), included(20))) == [2, 3]
    assert ids(prune(state, UNBOUNDED, UNBOUNDED, read_ts=49)) == [1, 2]
    assert ids(overlapping([run(9, 0, 5, 12)], state)) == [1, 2] and overlapping([], state) == []
    assert Run.from_json(state[0].to_json()) == state[0]
    binary = Run("x", "x", 0, 1, (b"\x00\xff",), (b"\xff",), 1, 1, 1, 1, True)
    assert Run.from_json(binary.to_json()) == binary


def test_factory_and_output_size():
    assert planner("leveled", level0_runs=2) == Leveled(level0_runs=2)
    with pytest.raises(ValueError):
        planner("other")
    assert output_files(Task((run(1, 0, size=10 * MB),), (), 1), 4 * MB) == 3
