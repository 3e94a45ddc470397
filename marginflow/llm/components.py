"""Connected components of a graph of links, by rounds of star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginflow.llm.frames import own_shuffle, saved, ship_code

TASK_LINKS = 1 << 16  # that a task holds together at a time


def reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of `n` nodes that each hangs together with over the links (`u`, `v`)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (`u`, `v`) from each node to the smallest that it hangs together with, by TASK_LINKS edges."""

    def held_together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in ("u", "v")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        label = reachable(len(nodes), *np.split(at, 2))
        some = label != np.arange(len(nodes))
        return pa.RecordBatch.from_pydict({"u": pa.array(nodes[some]), "v": pa.array(nodes[label[some]])})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TASK_LINKS:
            yield held_together(held)
            held, n = [], 0
    if n:
        yield held_together(held)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that hold together what `edges` (`u`, `v`, written) do, each once.

    There is a task for each TASK_LINKS edges, which makes stars of those it has. So few edges, of
    which each round would be many small tasks, are stars at once, and many get fewer and shorter.
    """
    ship_code(edges.sparkSession)
    tasks = max(1, -(-edges.count() // TASK_LINKS))
    return edges.coalesce(tasks).mapInArrow(stars, "u long, v long").distinct()


def _least(edges: DataFrame, name: str) -> DataFrame:
    """(`_u`, `name`): the smallest `v` of each `u`, for a join that can split a large hub."""
    return edges.groupBy("u").agg(F.min("v").alias(name)).select(
        own_shuffle("u").alias("_u"), name
    )


def _with_least(edges: DataFrame, of: DataFrame) -> DataFrame:
    least = _least(of, "_m")
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "_m")


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere: the edges are stars by then."""
    points, is_hub = F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hub")), F.struct(
        F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("hub")
    )
    ends = edges.select(F.inline(F.array(points, is_hub)))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return nodes.filter("out + hub > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(`node`, `component`) for edges (`u`, `v`): the smallest node that can be reached.

    Tasks make stars of the edges they have. Each round then points all neighbours of a node to the
    smallest of them, first the larger neighbours, then the smaller ones, until only stars are left;
    the rounds grow with the logarithm of the longest chain. Edges only ever move to smaller nodes and their number
    does not grow. Every round is written out. Edges with a null end or two equal ends are
    void; repeated ones count once. Without edges there are no rows.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    known = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = saved(contracted(saved(known.select(u.alias("u"), v.alias("v")))))
    for _ in range(most_rounds):
        if _settled(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_least(both, both)
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("_m", "u").alias("v"))
        )
        large = large.distinct()
        small = _with_least(large, large)
        current = saved(
            small.select("u", F.col("_m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("_m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
