import random

import pytest

from citegraph.llm.components import connected_components


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(2, 1), (1, 2), (2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)],
    [(5, None), (None, 3), (5, 4)], [(-3, 7), (7, 9), (100, 101)],
])
def test_small(frame, links):
    check(frame, links)


def test_random(frame):
    r = random.Random(3)
    check(frame, [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)])


def check(frame, links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(frame(links, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)
