"""Sparse matrices as rows, and the recheck of flows with one branch out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.shared import hint_if_small


def block_product(a: DataFrame, b: DataFrame, size: int = 256) -> DataFrame:
    """(i, j, v): the product of a(i, k, v) and b(k, j, v), indices whole numbers from 0; entries that come out as 0 have no row.

    Entries are packed into blocks of size x size; blocks meet by the block of k, so that an inner index with very many entries on both sides is a
    product of dense blocks instead of one row for each pair of its entries. Products are summed by (i, j), partly within tasks.
    """
    def packed(df: DataFrame, row: str, col: str, names: tuple[str, str], entries: str) -> DataFrame:
        at = [F.expr(f"{c} div {size}").alias(n) for c, n in zip((row, col), names, strict=True)]
        one = F.struct((F.col(row) % size).cast("int").alias("r"), (F.col(col) % size).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
        return df.groupBy(*at).agg(F.collect_list(one).alias(entries))

    met = packed(a, "i", "k", ("bi", "bk"), "left").join(packed(b, "k", "j", ("bk", "bj"), "right"), "bk").select("bi", "bj", "left", "right")

    def dense(entries: pa.StructArray) -> np.ndarray:
        m = np.zeros((size, size))
        np.add.at(m, (entries.field("r").to_numpy(), entries.field("c").to_numpy()), entries.field("v").to_numpy())
        return m

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                m = dense(batch.column(2)[row].values) @ dense(batch.column(3)[row].values)
                i, j = np.nonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(i + size * batch.column(0)[row].as_py()), pa.array(j + size * batch.column(1)[row].as_py()), pa.array(m[i, j])], ["i", "j", "v"])

    return met.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")


def recheck(flows: DataFrame, limits: DataFrame, lodf: DataFrame, times: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(monitor, outage, worst, weight): the branches over their limit, intact (outage -1) and with one branch out.

    flows(t, branch, f), limits(branch, cap), lodf(monitor, outage, c), times(t, w). With a branch out, a monitor carries its own flow and the share c of the
    branch's: a join with the rows of lodf. Pairs without such a row keep the intact loading and are never formed; they are not
    reported again. A branch is no monitor of its own outage.
    """
    at = flows.join(hint_if_small(limits), "branch").join(hint_if_small(times), "t")
    own = at.select(F.col("branch").alias("monitor"), F.lit(-1).cast("long").alias("outage"), "t", "w", (F.abs("f") / F.col("cap")).alias("load"))
    share = lodf.where("c <> 0 and monitor <> outage")
    moved = share.join(flows.select(F.col("branch").alias("outage"), "t", (F.col("f")).alias("_f")), "outage").select("monitor", "outage", "t", (F.col("_f") * F.col("c")).alias("_move"))
    after = moved.join(at.withColumnRenamed("branch", "monitor"), ["monitor", "t"]).select("monitor", "outage", "t", "w", (F.abs(F.col("f") + F.col("_move")) / F.col("cap")).alias("load"))
    over = own.unionByName(after).where(F.col("load") > 1 + tol)
    return over.groupBy("monitor", "outage").agg(F.max("load").alias("worst"), F.sum("w").alias("weight"))
