"""A score matrix as tiles: all scores of a large pool, without a row per pair.

``ScoreTiles`` holds a table with one row per pool row and block of targets::

    src int, pool_id bigint, block int, scores array<double>

and a small one that names each block's targets, in the order of the scores::

    block int, target_ids array<bigint>

A matrix of N pool rows and T targets is N * ceil(T / width) rows whose keys are
stored once per block. Scaling, bounds, means, union, the sink and the reader work
on whole arrays; ``unnest`` is there for those who do want one row per pair.

``columns_of`` gives the same scores by target: one row per target and batch of
pool rows. That is the shape of influence files, which hold a map per target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.operators import similarity as SIM

WIDTH = 256                 # targets of a block
ROWS = 1000                 # pool rows of a batch by target
BLOCKS_SCHEMA = "block int, target_ids array<bigint>"


@dataclass(frozen=True)
class ScoreTiles:
    tiles: DataFrame
    blocks: DataFrame

    def unnest(self) -> DataFrame:
        """``target_id, src, pool_id, score``, a row per pair."""
        pair = F.explode(F.arrays_zip("target_ids", "scores"))
        return (self.tiles.join(self.blocks, "block").select("src", "pool_id", pair.alias("p"))
                .select(F.col("p.target_ids").alias("target_id"), "src", "pool_id", F.col("p.scores").alias("score")))

    def bounds(self) -> DataFrame:
        """``block, lo, hi``: each target's smallest and largest score, as arrays.
        Every task gives one row a block before anything is shuffled."""
        v = array_to_vector(F.col("scores"))
        return (self.tiles.groupBy("block").agg(Summarizer.metrics("min", "max").summary(v).alias("m"))
                .select("block", vector_to_array("m.min").alias("lo"), vector_to_array("m.max").alias("hi")))

    def scaled(self) -> ScoreTiles:
        """Scores scaled to [0, 1] per target; a constant target gives 0. The
        bounds are as large as the target ids, so they go where those go."""
        span = F.zip_with("scores", F.arrays_zip("lo", "hi"), lambda s, b: F.coalesce(F.try_divide(s - b["lo"], b["hi"] - b["lo"]), F.lit(0.0)))
        return ScoreTiles(self.tiles.join(self.bounds(), "block").select("src", "pool_id", "block", span.alias("scores")), self.blocks)

    def means(self) -> DataFrame:
        """``src, pool_id, score``: each pool row's mean over all targets."""
        total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s)
        return (self.tiles.select("src", "pool_id", total.alias("total"), F.size("scores").alias("n")).groupBy("src", "pool_id")
                .agg((F.sum("total") / F.sum("n")).alias("score")))

    def union(self, *others: ScoreTiles) -> ScoreTiles:
        """The tiles of shards of one pool, scored against the same targets; other
        blocks than these are refused."""
        own = sorted((r["block"], list(r["target_ids"])) for r in self.blocks.collect())                      # as large as the target set
        tiles = self.tiles
        for other in others:
            if sorted((r["block"], list(r["target_ids"])) for r in other.blocks.collect()) != own:
                raise ValueError("the shards were scored against different targets")
            tiles = tiles.unionByName(other.tiles)
        return ScoreTiles(tiles, self.blocks)


def score_tiles(pool: DataFrame, targets, width: int = WIDTH, *, normalise: bool = True, pool_id: str = "pool_id", src: str = "src",
                target_id: str = "target_id", vec: str = "vec", max_broadcast_bytes: int = SIM.DEFAULT_MAX_BROADCAST_BYTES) -> ScoreTiles:
    """Scores of every pool row against every target, ``width`` targets a block in
    order of their ids. Columns as in :func:`sieve.operators.similarity.cosine_scores`.
    Without targets, or without pool rows, there are no tiles."""
    spark = pool.sparkSession
    tm = targets if isinstance(targets, (SIM.TargetMatrix, SIM.TargetBlocks)) else SIM.target_matrix(targets, target_id, vec, normalise, max_broadcast_bytes)
    tiles, named, first = spark.createDataFrame([], SIM.TILE_SCHEMA), [], 0
    for n, (ids, mat) in enumerate(tm.blocks if len(tm.ids) else []):
        bc = (spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(mat))
        part = SIM._scan(pool, *bc, mode="tiles", k=0, largest=True, normalise=normalise, vec_col=vec, src_col=src, id_col=pool_id, d=tm.d, width=width, first_block=first)
        tiles = part if n == 0 else tiles.unionByName(part)
        named += [(first + i // width, [int(t) for t in ids[i:i + width]]) for i in range(0, len(ids), width)]
        first += -(-len(ids) // width)
    return ScoreTiles(tiles, spark.createDataFrame(named, BLOCKS_SCHEMA))


def columns_of(pool: DataFrame, targets, rows: int = ROWS, *, normalise: bool = True, pool_id: str = "pool_id", src: str = "src",
               target_id: str = "target_id", vec: str = "vec", max_broadcast_bytes: int = SIM.DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``target_id, src, pool_ids, scores``: the same scores, a row per target and
    batch of at most ``rows`` pool rows of one source."""
    spark = pool.sparkSession
    tm = targets if isinstance(targets, (SIM.TargetMatrix, SIM.TargetBlocks)) else SIM.target_matrix(targets, target_id, vec, normalise, max_broadcast_bytes)
    out = None
    for ids, mat in tm.blocks if len(tm.ids) else []:
        bc = (spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(mat))
        part = SIM._scan(pool, *bc, mode="columns", k=0, largest=True, normalise=normalise, vec_col=vec, src_col=src, id_col=pool_id, d=tm.d, width=rows)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SIM.COLUMN_SCHEMA)


def listed(scores: Column | str) -> Column:
    """An array of scores as text, in millionths: for comparison only."""
    c = F.col(scores) if isinstance(scores, str) else scores
    return F.array_join(F.transform(c, lambda s: F.round(s * 1e6).cast("long").cast("string")), ",")
