"""Blocks of cells with sampled neighbourhoods, numbered anew within each block, for encoders that train on graph pieces.

A cell of at most fan_out neighbours gives them all, others so many draws with replacement. A draw is a place among the
cell's neighbours, which follows by a hash from seed, hop, block, cell and draw; neighbours are numbered once per graph, by a global order
of the edges, so that a cell of very many neighbours is never in one task. Draws then are a join on cell and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import checkpointed
from .prep import dense_index


def numbered_neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell_id, place, neighbour) with places from 0 by neighbour, and (cell_id, degree), of distinct edges (src, dst)."""
    rows = checkpointed(dense_index(edges.select(F.struct("src", "dst").alias("e")).distinct(), "e", "i"))
    size = rows.groupBy(F.col("e.src").alias("cell_id")).agg(F.min("i").alias("first"), F.count("*").alias("degree"))
    places = rows.select(F.col("e.src").alias("cell_id"), F.col("e.dst").alias("neighbour"), "i").join(size, "cell_id")
    return places.select("cell_id", (F.col("i") - F.col("first")).alias("place"), "neighbour"), size.select("cell_id", "degree")


def draw(seed: int, hop: int, block: Column, cell: Column, t: Column, n: Column) -> Column:
    """A number from 0 to n - 1."""
    text = F.concat_ws(",", F.lit(str(seed)), F.lit(str(hop)), block.cast("string"), cell.cast("string"), t.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def neighbour_blocks(edges: DataFrame, seeds: DataFrame, fan_outs: list[int], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (block, local, cell_id, hop) and edges (block, hop, src, dst, draw) of the blocks; src and dst are local numbers.

    seeds: (block, pos, cell_id). A block's seeds come first, by pos, then each hop's new cells by id. An edge leads from
    the neighbour to the cell that drew it, and occurs as often as it is drawn. A cell reached again isn't drawn for twice.
    Blocks are bounded by their seeds and fan-outs; a graph without edges gives the seeds alone.
    """
    if not fan_outs or min(fan_outs) < 1:
        raise ValueError("fan-outs are positive numbers, one for each hop")
    places, degrees = map(checkpointed, numbered_neighbours(edges))
    nodes = checkpointed(seeds.select("block", F.lit(0).alias("hop"), F.col("pos").cast("long").alias("pos"), "cell_id"))
    frontier, links = nodes, None
    for hop, fan in enumerate(fan_outs, 1):
        each = frontier.select("block", "cell_id").join(degrees, "cell_id").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(fan), "degree") - 1)))
        at = F.when(F.col("degree") <= fan, F.col("draw")).otherwise(draw(seed, hop, F.col("block"), F.col("cell_id"), F.col("draw"), F.col("degree")))
        took = checkpointed(each.withColumn("place", at).join(places, ["cell_id", "place"]).select("block", F.lit(hop).alias("hop"), "cell_id", "neighbour", "draw"))
        links = took if links is None else links.unionByName(took)
        new = took.select("block", F.col("neighbour").alias("cell_id")).distinct().join(nodes.select("block", "cell_id"), ["block", "cell_id"], "left_anti")
        frontier = checkpointed(new.select("block", F.lit(hop).alias("hop"), F.col("cell_id").cast("long").alias("pos"), "cell_id"))
        nodes = nodes.unionByName(frontier)
    # A block has a bounded number of cells, which are numbered in its own order.
    local = checkpointed(nodes.withColumn("local", F.row_number().over(Window.partitionBy("block").orderBy("hop", "pos")) - 1).select("block", "local", "cell_id", "hop"))
    ends = [local.select("block", F.col("cell_id").alias(c), F.col("local").alias(n)) for c, n in (("neighbour", "src"), ("cell_id", "dst"))]
    edges = links.join(ends[0], ["block", "neighbour"]).join(ends[1], ["block", "cell_id"])
    return local, edges.select("block", "hop", "src", "dst", "draw")
