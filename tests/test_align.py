import itertools
import random

import numpy as np
import pytest

from folioloom.operators import align as A
from folioloom.operators import rebalance as B
from tests.conftest import rows


def brute(ref, target, p):
    """The cheapest path by trying all of them, the first in order of its steps' starts."""
    n, m = len(ref), len(target)
    ratio = sum(target) / sum(ref)
    best = [float("inf")]

    def go(i, j, cost):
        if i == n and j == m:
            best[0] = min(best[0], cost)
        for a, b in itertools.product(range(1, p.most_ref + 1), range(1, p.most_target + 1)):
            if i + a <= n and j + b <= m:
                want, have = sum(ref[i : i + a]) * ratio, sum(target[j : j + b])
                go(i + a, j + b, cost + abs(want - have) / max(want, have, 1) + (a - 1) * p.ref_penalty + (b - 1) * p.target_penalty + p.position * abs((i + a) / n - (j + b) / m))

    go(0, 0, 0.0)
    return best[0]


@pytest.mark.parametrize("profile", [A.PAIRS, A.GROUPS])
def test_kernel_finds_the_cheapest_path(profile):
    rng = random.Random(3)
    for _ in range(40):
        ref, target = [rng.uniform(1, 90) for _ in range(rng.randint(1, 5))], [rng.uniform(1, 90) for _ in range(rng.randint(1, 5))]
        want = brute(ref, target, profile)
        if want == float("inf"):
            with pytest.raises(A.Unalignable):
                A.best_steps(np.array(ref), np.array(target), profile)
            continue
        steps = A.best_steps(np.array(ref), np.array(target), profile)
        assert sum(a for a, _, _ in steps) == len(ref) and sum(b for _, b, _ in steps) == len(target)
        got, x, y = 0.0, 0, 0
        for a, b, cost in steps:
            x, y = x + a, y + b
            got += cost + (a - 1) * profile.ref_penalty + (b - 1) * profile.target_penalty + profile.position * abs(x / len(ref) - y / len(target))
        assert got == pytest.approx(want)


CHAPTER = "chapter int, ref_idx array<int>, ref array<string>, target_idx array<int>, target array<string>"


def test_pairs_of_odd_chapters(spark):
    df = spark.createDataFrame([
        (1, [1, 2], ["甲乙丙丁。", "“走！”"], [1, 2], ["One two three.", "“Go!”"]), (2, [], [], [1], ["Only."]), (3, [], [], [], []), (4, [1], ["甲"], list(range(9)), ["x"] * 9)], CHAPTER)
    got = {(r.chapter, r.pair): r for r in A.align_pairs(df, ["chapter"]).collect()}
    assert [got[1, k].target for k in (1, 2)] == [["One two three."], ["“Go!”"]]
    assert got[2, 1].cost == 0.0 and got[2, 1].ref_idx is None
    assert not any(k[0] == 3 for k in got)
    assert got[4, 1].cost is None and len(got[4, 1].target) == 9


def test_groups_replicate_and_share_out(spark):
    df = spark.createDataFrame([(1, [1, 2], ["甲乙丙。", "甲乙丙。"], [1], ["One two. Three four."])], CHAPTER)
    same = rows(A.align_groups(df, ["chapter"], "zh", "en").select("row", "target"))
    assert same == [(1, ["One two. Three four."]), (2, ["One two. Three four."])]
    shared = rows(A.align_groups(df, ["chapter"], "zh", "en", split=lambda t: ["One two.", "Three four."]).select("row", "target"))
    assert shared == [(1, ["One two."]), (2, ["Three four."])]


def test_groups_keep_chapters_that_cannot_be_aligned(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["甲", "乙", "丙"], [7], ["One. Two."]), (2, [1], ["甲"], list(range(6)), ["x"] * 6), (3, [1], ["甲"], [4], ["y"])], CHAPTER)
    for split in (None, lambda t: t.split()):
        got = rows(A.align_groups(df, ["chapter"], "zh", "en", split=split).select("chapter", "row", "ref", "target", "aligned"))
        assert got == [(1, 1, "甲", ["One. Two."], False), (1, 2, "乙", ["One. Two."], False), (1, 3, "丙", ["One. Two."], False), (2, 1, "甲", ["x"] * 6, False), (3, 1, "甲", ["y"], True)]


def test_share_out_leaves_nothing_over():
    for n, m in [(2, 1), (3, 3), (2, 7)]:
        cuts = A.share_out([1.0] * n, [1.0] * m)
        assert [x for s, e in cuts for x in range(s, e)] == list(range(m)) and len(cuts) == n


def test_all_leading_rows_without_targets_are_folded(spark):
    df = spark.createDataFrame([(1, 1, ["a"], []), (1, 2, ["b"], []), (1, 3, ["c"], ["x"]), (1, 4, ["d"], []), (1, 5, ["e"], ["y"])], "chapter int, pair int, ref array<string>, target array<string>")
    assert rows(A.merge_empty(df, ["chapter"])) == [(1, 1, ["a", "b", "c", "d"], ["x"]), (1, 5, ["e"], ["y"])]


def test_rebalance_moves_but_keeps_targets():
    t = [B.Row(10, [(1, "a" * 200), (2, "b" * 20)]), B.Row(100, [(3, "c")]), B.Row(100, [(4, "d")])]
    assert B.rebalance_rows(t, [{1}, {2, 3}, {4}]) > 0
    assert [[p for p, _ in r.items] for r in t] == [[1], [2, 3], [4]]
    pulled = [B.Row(100, [(1, "x"), (2, "y")]), B.Row(10, []), B.Row(100, [(3, "z")])]
    assert B.rebalance_rows(pulled, [{1}, {2}, {3}]) == 1 and [p for p, _ in pulled[1].items] == [2]


def test_cosine_takes_the_first_of_equals(spark):
    s = spark.createDataFrame([("k", 1, [1.0, 0.0])], "block string, id long, embedding array<float>")
    t = spark.createDataFrame([("k", 9, [2.0, 0.0]), ("k", 5, [1.0, 0.0]), ("k", 7, [0.0, 0.0])], "block string, id long, embedding array<float>")
    assert rows(B.cosine_mapping(s, t, "block")) == [("k", 1, 5, 1.0)]
