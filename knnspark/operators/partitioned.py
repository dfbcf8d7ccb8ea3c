"""Categorical-key index: partitions by key, median-split leaves, and exact search by bounding boxes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knnspark.constants import TOP
from knnspark.functions.distance import box_bound
from knnspark.operators import blocks, cells

#: Rows of a node that one task splits in memory.
GROUP = 100_000


def boxes(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    col = lambda f: F.array(*[f(F.col("v")[i]) for i in range(dims)])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), col(F.min).alias("bmin"), col(F.max).alias("bmax"))


def lookup(q: DataFrame, parts: DataFrame) -> DataFrame:
    """Each query's own partition; a miss is kept, with null."""
    return q.join(parts.select("pkey", "n"), "pkey", "left")


def search(q: DataFrame, ref: DataFrame, stats: DataFrame, dims: int, by: list[str]) -> DataFrame:
    """Own partition first, then every box whose bound is not above the fifth distance found (ties matter: <=).

    q: qid, qv, pkey. ref: rid, v, label, pkey and the columns `by`. Rows of a partition lie in cells, dealt to tasks once; queries
    come to them in blocks, each first to the cell of its own partition where it lies. Pieces of a cell (or the leaves, where
    `by` names them) have boxes of their own, which lie within those of `stats`.
    """
    cuts, rows = cells.packed(ref, by)
    return blocks.each_block(q.select("qid", "qv", "pkey"), lambda some, _: cells.nearest(cuts, rows, some, TOP, ref), blocks.QUERIES)


def within(q: DataFrame, ref: DataFrame, k: int, first: int) -> DataFrame:
    """As `knn.within`, by cells: qid, rid, d of all rows as near as the k-th nearest or, where there are fewer, the farthest.

    q: qid, qv, pkey. ref: rid, v, label, pkey. Boxes first, then the first dimensions, the rest for what is left.
    """
    cuts, rows = cells.packed(ref, ["pkey"])

    def one(some: pa.Table, _: None) -> DataFrame:
        return cells.within(cuts, rows, some, blocks.farthest(some, cells.nearest(cuts, rows, some, k, ref)), first, ref)

    return blocks.each_block(q.select("qid", "qv", "pkey"), one, blocks.QUERIES)


def bounds(q: DataFrame, stats: DataFrame, dims: int) -> DataFrame:
    """qid, pkey, lb and its rank, for all partitions (their number is bounded by the key)."""
    lb = box_bound(F.col("qv"), F.col("bmin"), F.col("bmax"), dims)
    return q.select("qid", "qv").join(F.broadcast(stats.select("pkey", "bmin", "bmax"))).select("qid", "pkey", lb.alias("lb"))


def split(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """One level: nodes with more than `most` rows fall in two at the median of their widest dimension (the lowest of equals).

    rows: rid, v, pkey, leaf. The left half has n div 2 rows; ties go by rid.
    """
    width = boxes(rows, ["pkey", "leaf"], dims)
    span = F.array(*[F.struct((F.col("bmax")[i] - F.col("bmin")[i]).alias("w"), F.lit(-i).alias("i")) for i in range(dims)])
    widest = width.select("pkey", "leaf", "n", (-F.array_max(span)["i"]).alias("dim"))
    marked = rows.join(widest, ["pkey", "leaf"])
    place = F.row_number().over(Window.partitionBy("pkey", "leaf").orderBy(F.col("v")[F.col("dim")], "rid"))
    side = F.when(F.col("n") <= most, "").when(place <= F.floor(F.col("n") / 2), "0").otherwise("1")
    return marked.withColumn("leaf", F.concat("leaf", side)).select(*rows.columns)


def leaves(rows: DataFrame, dims: int, most: int, levels: int | None = None) -> DataFrame:
    """Splits until no leaf has more than `most` rows, or `levels` times. Halves differ by a row, so the largest partition tells how often.

    Nodes of more than GROUP rows are split level by level, and each level is written, as it is read twice and plans would double; a
    smaller node is split to its end in one task.
    """
    rows = rows if blocks.held(rows) else rows.persist()  # read twice
    often = lambda size: max(0, -(-largest // size) - 1).bit_length()
    largest = rows.groupBy("pkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = often(most) if levels is None else levels
    shared = min(levels, often(GROUP))
    out = rows.withColumn("leaf", F.lit(""))
    for _ in range(shared):
        out = split(_written(out), dims, most)
    return _ended(out, most, levels - shared) if levels > shared else out


def _written(rows: DataFrame) -> DataFrame:
    """The rows without their plan, in the checkpoint folder where one is named."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.localCheckpoint()


def _ended(rows: DataFrame, most: int, levels: int) -> DataFrame:
    """All further levels of each node, in memory."""
    blocks.prepare(rows.sparkSession)

    def end(node: pa.Table) -> pa.Table:
        x, rids = blocks.ints(node.column("v")), node.column("rid").to_numpy()
        names, waiting = np.full(len(x), "", object), [(np.arange(len(x)), node.column("leaf")[0].as_py(), levels)]
        while waiting:
            of, name, left = waiting.pop()
            if len(of) <= most or not left:
                names[of] = name
                continue
            part = x[of]
            order = of[np.lexsort((rids[of], part[:, np.argmax(part.max(0) - part.min(0))]))]
            waiting += [(order[: len(of) // 2], name + "0", left - 1), (order[len(of) // 2 :], name + "1", left - 1)]
        at = node.schema.get_field_index("leaf")
        return node.set_column(at, node.schema.field(at), pa.array(names.tolist(), node.schema.field(at).type))

    return rows.groupBy("pkey", "leaf").applyInArrow(end, rows.schema)
