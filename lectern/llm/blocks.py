"""Links within large buckets, found block by block, so that no task holds a bucket.

A bucket's members are dealt to blocks of bounded size. Every block is searched with one member of the bucket, its
hub, added: most members of a group of near copies are connected then, whatever blocks they are in. Members that are
not connected with their bucket's hub are strays; they are sent to all blocks of the bucket and compared with the
members there. Two members that are connected with the hub need no comparison, any other pair has a stray in it and
is compared, so the components are those of all pairs. Work beyond one pass over the members grows with the strays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import connected_components

BUCKET = ["t", "key"]
EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
#: nodes, payloads, component of each, whether it is a stray -> links as places in these lists.
Search = Callable[[np.ndarray, list, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def searched(rows: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """Edges (src, dst) of rows(keys, node, payload, root, stray), by groups of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def links() -> pa.RecordBatch:
            node, payload, root, stray = zip(*held)
            a, b = search(np.array(node, np.int64), list(payload), np.array(root, np.int64), np.array(stray, bool))
            ids = np.array(node, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], schema=EDGE)

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(len(keys) + 4)]
            for *key, node, payload, root, stray in zip(*cols):
                if key != at:
                    if len(held) > 1:
                        yield links()
                    at, held = key, []
                held.append((node, payload, root, stray))
        if len(held) > 1:
            yield links()

    sorted_rows = rows.select(*keys, "node", "payload", "root", "stray").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(run, "src long, dst long")


def block_links(members: DataFrame, block: int, search: Search) -> DataFrame:
    """Edges whose components are those of all links within the buckets of members(t, key, n, node, payload); n is the
    bucket's size."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = members.select(*BUCKET, "node", "payload", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("salt"))
    hub = written(dealt.groupBy(*BUCKET).agg(F.min_by(F.struct("node", "payload"), "node").alias("h"), F.max("blocks").alias("blocks")))
    whole = lambda df: df.withColumns({"root": F.col("node"), "stray": F.lit(False)})
    spread = hub.select(*BUCKET, F.col("h.node").alias("node"), F.col("h.payload").alias("payload"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    first = written(searched(whole(dealt.select(*spread.columns).unionByName(spread)), [*BUCKET, "salt"], search))
    if not (hub.agg(F.max("blocks")).first()[0] or 0) > 1:
        return first
    root = connected_components(first)
    large = dealt.where("blocks > 1")
    named = large.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    hubs = hub.select(*BUCKET, F.col("h.node").alias("node")).join(root, "node", "left").select(*BUCKET, F.coalesce("root", "node").alias("top"))
    strays = written(named.join(hubs, BUCKET).where("root <> top").select(*BUCKET, "node", "payload", "root", "blocks", "salt"))
    if strays.isEmpty():
        return first
    sent = strays.withColumn("own", F.col("salt")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    around = named.join(strays.select(*BUCKET).distinct(), BUCKET, "left_semi").withColumn("stray", F.lit(False))
    names = [*BUCKET, "salt", "node", "payload", "root", "stray"]
    second = searched(around.select(*names).unionByName(sent.withColumn("stray", F.lit(True)).select(*names)), [*BUCKET, "salt"], search)
    return first.unionByName(second)
