"""Reachability over the reference tables of documents: which objects nothing reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.session import ensure_checkpoint_dir


def reachable(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, num) of all that roots (doc_id, num) lead to over refs (doc_id, src, dst).

    Breadth first, a join a level; each level is checkpointed alone, so a level costs what it finds, and a lost executor
    costs no earlier one. Levels met are held as a few tables, which grow together like a binary counter: what is found
    is written again a logarithmic number of times. The loop ends when a level adds nothing, however deep that is.
    """
    ensure_checkpoint_dir(roots.sparkSession)
    edge = refs.select("doc_id", F.col("src").alias("num"), F.col("dst").alias("next")).checkpoint()
    front = roots.select("doc_id", "num").distinct().checkpoint()
    held: list[tuple[int, DataFrame]] = [(1, front)]
    while True:
        front = front.join(edge, ["doc_id", "num"]).select("doc_id", F.col("next").alias("num")).distinct()
        for _, seen in held:
            front = front.join(seen, ["doc_id", "num"], "left_anti")
        front = front.checkpoint()
        if front.isEmpty():
            break
        held.append((1, front))
        while len(held) > 1 and held[-1][0] == held[-2][0]:
            (n, a), (_, b) = held.pop(), held.pop()
            held.append((2 * n, a.union(b).checkpoint()))
    out = held[0][1]
    for _, more in held[1:]:
        out = out.union(more)
    return out


def unreferenced(objects: DataFrame, roots: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects (doc_id, num) that no root leads to."""
    return objects.join(reachable(roots, refs), ["doc_id", "num"], "left_anti")
