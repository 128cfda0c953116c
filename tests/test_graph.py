"""Reachability over long chains, loops and many documents, against a plain search."""

import random

from parchment.operators import graph


def plain(roots, refs):
    seen, todo = set(roots), list(roots)
    while todo:
        doc, num = todo.pop()
        for d, a, b in refs:
            if (d, a) == (doc, num) and (d, b) not in seen:
                seen.add((d, b))
                todo.append((d, b))
    return seen


def test_chains_loops_and_hubs(spark):
    rng = random.Random(2)
    refs = [(1, k, k + 1) for k in range(9)] + [(1, 9, 0)] + [(2, 0, k) for k in range(50)] + [(3, rng.randrange(20), rng.randrange(20)) for _ in range(25)]
    roots = [(1, 3), (2, 0), (3, 0), (4, 7)]
    frame = spark.createDataFrame(refs, "doc_id long, src long, dst long")
    got = graph.reachable(spark.createDataFrame(roots * 2, "doc_id long, num long"), frame)
    assert sorted((r.doc_id, r.num) for r in got.collect()) == sorted(plain(roots, refs))
    objects = spark.createDataFrame([(3, k) for k in range(20)], "doc_id long, num long")
    left = {r.num for r in graph.unreferenced(objects, spark.createDataFrame(roots, "doc_id long, num long"), frame).collect()}
    assert left == {k for k in range(20) if (3, k) not in plain(roots, refs)}
