import random

import pytest

from tablecare.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty", "sorted path"])
def test_equals_union_find(spark, kind):
    rng = random.Random(kind)
    names = rng.sample(range(-(10**12), 10**12), 120)
    edges = {
        "random": [(rng.choice(names), rng.choice(names)) for _ in range(90)],
        "path": list(zip(names, names[1:])),
        "star": [(names[0], x) for x in names] + [(names[-1], names[0])] * 3,
        "empty": [],
        "sorted path": list(zip(sorted(names)[:25], sorted(names)[1:25])),
    }[kind]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    assert len({(got[x], label[x]) for x in linked}) == len({label[x] for x in linked}) == len(set(got.values()))
