"""Cosine similarity between a large pool and a small target set.

The pool is scanned once; the target matrix goes to every task as a broadcast
variable after its size has been checked (``max_broadcast_bytes``). Target sets
larger than that are cut into blocks that each fit, and the pool is scanned
once per block. Inside a task the scores of one Arrow batch are one NumPy
matrix product, so nothing leaves the JVM row by row.

Output modes of the Arrow scan:

* ``pairs`` – every (target, pool row) score, long form;
* ``tiles`` – a row per pool row and block of targets, with an array of scores, and
  ``columns`` – a row per target and batch of pool rows (see ``operators.tiles``);
* ``topk``  – a running best ``k`` per target over the whole partition (ties
  broken by ``(src, pool_id)``). Candidates are held in a buffer of bounded size;
  when it fills with rows that are all still needed it is emitted, and later rows
  must beat the k-th score reached so far. For large ``k`` a first scan counts
  scores per target into bins; the bin that holds the k-th best of the whole pool
  gives a cut-off for the second scan, so partitions of fewer than ``k`` rows are
  reduced as well and about ``k`` rows per target leave the scan altogether;
* ``mean``  – the mean score of each pool row over all targets (the mean of
  dot products equals the dot product with the mean target, but we average the
  individual scores to stay close to the reference's arithmetic).

Schema of a score table everywhere in the package:
``target_id bigint, src int, pool_id bigint, score double``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions import vectors as V

SCORE_SCHEMA = "target_id bigint, src int, pool_id bigint, score double"
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_MAX_DRIVER_BYTES = 2 * 1024 * 1024 * 1024
TILE_BYTES = 32 * 1024 * 1024       # of one rows x targets block of scores inside a task
TOPK_BUFFER_ROWS = 1 << 22          # candidates that a task holds, 32 bytes each
EMIT_ROWS = 1 << 18                 # rows of one emitted record batch
GROUP_PARTITIONS = 32               # partitions whose survivors are ranked in one task
CUTOFF_LEAST_K = 2048               # from this k on a histogram scan goes ahead of the top-k scan
CUTOFF_BINS, CUTOFF_CELLS = 2048, 1 << 22       # bins per target, and bins of all targets in a task (8 bytes each)


class TooLargeToBroadcast(ValueError):
    pass


# --------------------------------------------------------------------------
# small-side collection with a size check
# --------------------------------------------------------------------------

class TargetMatrix:
    """A collected, size-checked target set: ``ids`` (sorted) and ``blocks`` of
    rows that each fit the broadcast limit. Build it once and pass it to several
    scoring calls to avoid collecting the targets again."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, max_bytes: int, normalised: bool):
        self.ids, self.mat, self.normalised = ids, mat, normalised
        self.d = mat.shape[1] if mat.ndim == 2 else 0
        per_block = max(1, max_bytes // max(1, self.d * 8))
        self.blocks = [(ids[i:i + per_block], mat[i:i + per_block]) for i in range(0, max(len(ids), 1), per_block)]


class TargetBlocks:
    """A target set beyond the driver limit, with the same face: only its ids are
    held, and iterating ``blocks`` reads one range of ids after the other, so the
    driver holds one block at a time. Every pass over the blocks reads them anew."""

    def __init__(self, targets: DataFrame, id_col: str, vec_col: str, ids: np.ndarray, d: int, max_bytes: int, normalised: bool):
        self.targets, self.id_col, self.vec_col, self.ids, self.d, self.normalised = targets, id_col, vec_col, ids, d, normalised
        distinct = np.unique(ids)
        self.starts = distinct[::max(1, max_bytes // max(1, d * 8))].tolist()
        self.blocks = self

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self):
        for low, high in zip(self.starts, [*self.starts[1:], None]):
            own = F.col(self.id_col).cast("long")
            part = self.targets.where((own >= low) if high is None else (own >= low) & (own < high))
            ids, mat = _collected(part, self.id_col, self.vec_col, self.d)
            yield ids, _unit_rows(mat) if self.normalised else mat


def _collected(targets: DataFrame, id_col: str, vec_col: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    tbl = targets.select(F.col(id_col).cast("long").alias("id"), V.as_double(F.col(vec_col)).alias("v")).orderBy("id").toArrow()
    ids = tbl.column("id").to_numpy()
    flat = tbl.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, np.asarray(flat, dtype=np.float64).reshape(len(ids), d) if len(ids) else np.zeros((0, d))


def collect_matrix(targets: DataFrame, id_col: str = "target_id", vec_col: str = "vec",
                   max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, max_driver_bytes: int | None = None):
    """Collect ``(ids, matrix)`` of a target set after checking its size.

    The size is computed on the cluster first (count and width), so an
    oversized side is refused before anything is pulled to the driver
    (:func:`target_matrix` then reads it block by block).
    ``max_driver_bytes`` bounds the whole set; each broadcast block is bounded
    by ``max_bytes``.
    """
    stats = targets.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("d"),
                        F.min(F.size(vec_col)).alias("d_min")).first()
    n, d = int(stats["n"]), int(stats["d"] or 0)
    if n and stats["d_min"] != d:
        raise ValueError("target vectors have different lengths")
    limit = max_driver_bytes if max_driver_bytes is not None else max(DEFAULT_MAX_DRIVER_BYTES, max_bytes)
    if n * d * 8 > limit:
        raise TooLargeToBroadcast(f"{n} x {d} doubles exceed {limit} bytes")
    return _collected(targets, id_col, vec_col, d)


def target_matrix(targets: DataFrame, id_col: str = "target_id", vec_col: str = "vec", normalise: bool = True,
                  max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> TargetMatrix | TargetBlocks:
    """The target set in blocks: collected at once if it fits the driver limit,
    else read block by block."""
    try:
        ids, mat = collect_matrix(targets, id_col, vec_col, max_broadcast_bytes)
    except TooLargeToBroadcast:
        held = targets.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("d")).toArrow()      # 12 bytes a target
        return TargetBlocks(targets, id_col, vec_col, np.sort(held.column("id").to_numpy()), int(held.column("d")[0].as_py()), max_broadcast_bytes, normalise)
    return TargetMatrix(ids, _unit_rows(mat) if normalise and len(mat) else mat, max_broadcast_bytes, normalise)


# --------------------------------------------------------------------------
# Arrow batch scoring
# --------------------------------------------------------------------------

def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.maximum(norms, V.EPS)[:, None]


def _batch_matrix(batch: pa.RecordBatch, vec_col: str, d: int) -> np.ndarray:
    col = batch.column(vec_col)
    if col.null_count:
        raise ValueError("null vector in pool")
    lengths = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths.min() != d or lengths.max() != d):
        raise ValueError(f"pool vectors must have {d} dimensions")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(batch.num_rows, d)


class _RunningTopk:
    """Best k rows per target of one partition, ties by (src, pool_id).

    ``key`` is the score, negated where the largest are wanted. ``cut`` holds
    for each target a key that k rows seen so far reach, so a larger key can't
    be among the best k; a row that equals it must also come no later than
    ``cut_src, cut_pid``, which are known after the buffer has been reduced.
    NaN scores take no part. ``cut`` may start from keys that k rows of the
    whole pool are known to reach."""

    def __init__(self, n_targets: int, k: int, largest: bool, most: int, cut: np.ndarray | None = None):
        self.k, self.largest, self.most = k, largest, most
        self.cut = np.full(n_targets, np.inf) if cut is None else cut.copy()
        self.cut_src = np.full(n_targets, np.iinfo(np.int32).max, np.int32)
        self.cut_pid = np.full(n_targets, np.iinfo(np.int64).max, np.int64)
        self.parts: list[tuple] = []
        self.held, self.reduce_at = 0, min(most, EMIT_ROWS)

    def add(self, S: np.ndarray, src: np.ndarray, pid: np.ndarray) -> list[tuple]:
        """Takes a block of scores (rows x targets); returns what must leave the buffer."""
        key = np.negative(S) if self.largest else S
        if len(S) > self.k:
            ranked = np.where(np.isnan(key), np.inf, key)
            reached = np.partition(ranked, self.k - 1, axis=0)[self.k - 1]
            lower = reached < self.cut
            self.cut = np.where(lower, reached, self.cut)
            self.cut_src[lower], self.cut_pid[lower] = np.iinfo(np.int32).max, np.iinfo(np.int64).max
        row, col = np.nonzero(key <= self.cut)          # false for NaN
        key, src, pid = key[row, col], src[row], pid[row]
        tie = key == self.cut[col]
        late = tie & ((src > self.cut_src[col]) | ((src == self.cut_src[col]) & (pid > self.cut_pid[col])))
        keep = ~late
        out: list[tuple] = []
        col, src, pid, key = col[keep], src[keep], pid[keep], key[keep]
        for i in range(0, len(key), EMIT_ROWS):         # a block adds at most EMIT_ROWS between two checks
            part = tuple(x[i:i + EMIT_ROWS] for x in (col, src, pid, key))
            self.parts.append(part)
            self.held += len(part[3])
            if self.held >= self.reduce_at:
                self._reduce()
                if self.held > self.most // 2:
                    out += self.drain()
                self.reduce_at = min(self.most, max(EMIT_ROWS, 2 * self.held))
        return out

    def _reduce(self) -> None:
        col, src, pid, key = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((pid, src, key, col))
        col, src, pid, key = col[order], src[order], pid[order], key[order]
        first = np.searchsorted(col, np.arange(len(self.cut)))
        place = np.arange(len(col)) - first[col]
        last = np.flatnonzero(place == self.k - 1)
        better = last[key[last] <= self.cut[col[last]]]
        self.cut[col[better]], self.cut_src[col[better]], self.cut_pid[col[better]] = key[better], src[better], pid[better]
        keep = place < self.k
        self.parts = [(col[keep], src[keep], pid[keep], key[keep])]
        self.held = int(keep.sum())

    def drain(self) -> list[tuple]:
        out, self.parts, self.held = self.parts, [], 0
        return out

    def end(self) -> list[tuple]:
        if self.parts:
            self._reduce()
        return self.drain()


def _bins(n_targets: int) -> int:
    return max(2, min(CUTOFF_BINS, CUTOFF_CELLS // max(1, n_targets)))


MEAN_SCHEMA = "src int, pool_id bigint, score double, n_targets bigint"
BOUNDS_SCHEMA = "target_id bigint, lo double, hi double"
BINS_SCHEMA = "target_id bigint, counts array<double>"
TILE_SCHEMA = "src int, pool_id bigint, block int, scores array<double>"
GROUPED_SCHEMA = SCORE_SCHEMA + ", grp string"
COLUMN_SCHEMA = "target_id bigint, src int, pool_ids array<bigint>, scores array<double>"


def _scan(pool: DataFrame, ids_bc, mat_bc, *, mode: str, k: int, largest: bool, normalise: bool,
          vec_col: str, src_col: str, id_col: str, d: int, bounds_bc=None, cut_bc=None, scale: float = 1.0,
          width: int = 0, first_block: int = 0, depths: dict | None = None) -> DataFrame:
    out_schema = {"mean": MEAN_SCHEMA, "normmean": MEAN_SCHEMA, "bounds": BOUNDS_SCHEMA, "bins": BINS_SCHEMA, "tiles": TILE_SCHEMA,
                  "columns": COLUMN_SCHEMA, "grouped": GROUPED_SCHEMA}.get(mode, SCORE_SCHEMA)

    tile, buffer = TILE_BYTES, TOPK_BUFFER_ROWS

    def fn(batches):
        tids = ids_bc.value
        T = mat_bc.value
        lo_hi = bounds_bc.value if bounds_bc is not None else None
        step = max(1, tile // max(8, 8 * len(tids)))      # rows whose scores fit a tile
        best = _RunningTopk(len(tids), k, largest, buffer, cut_bc.value if cut_bc is not None else None) if mode == "topk" else None
        by_group = {g: _RunningTopk(len(tids), n, largest, max(EMIT_ROWS, buffer // len(depths))) for g, n in depths.items()} if mode == "grouped" else {}
        bounds = None
        bins = _bins(len(tids))
        cells = np.zeros(len(tids) * bins, np.int64) if mode == "bins" else None

        def emit(parts, group=None):
            for col, src, pid, key in parts:
                for i in range(0, len(key), EMIT_ROWS):
                    at = slice(i, i + EMIT_ROWS)
                    rows = [pa.array(tids[col[at]]), pa.array(src[at]), pa.array(pid[at]), pa.array(-key[at] if largest else key[at])]
                    names = ["target_id", "src", "pool_id", "score"]
                    if group is not None:
                        rows, names = [*rows, pa.array([group] * len(rows[0]))], [*names, "grp"]
                    yield pa.RecordBatch.from_arrays(rows, names=names)

        def arrays(m):                                        # a list of each row of m
            return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)[:len(m) + 1], pa.array(np.ascontiguousarray(m).ravel()))

        def means(src, pid, m):
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(pid), pa.array(m), pa.array(np.full(len(pid), len(tids), dtype=np.int64))],
                                              names=["src", "pool_id", "score", "n_targets"])

        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                X = _batch_matrix(b, "vec", d)
                if normalise:
                    X = _unit_rows(X)
                S = X @ T.T  # rows x targets
                src = b.column("src").to_numpy(zero_copy_only=False).astype(np.int32)
                pid = b.column("pool_id").to_numpy(zero_copy_only=False).astype(np.int64)
                if mode == "topk":
                    yield from emit(best.add(S, src, pid))
                elif mode == "grouped":
                    groups = np.array(b.column("grp").to_pylist(), object)
                    for g, held in by_group.items():
                        if (own := groups == g).any():
                            yield from emit(held.add(S[own], src[own], pid[own]), g)
                elif mode == "bins":
                    key = np.negative(S) if largest else S
                    at = np.clip((key + scale) * (bins / (2 * scale)), 0, bins - 1)
                    at, col = at[ok := ~np.isnan(at)].astype(np.int64), np.nonzero(ok)[1]
                    cells += np.bincount(col * bins + at, minlength=len(cells))
                elif mode == "bounds":
                    lo, hi = S.min(axis=0), S.max(axis=0)
                    bounds = (lo, hi) if bounds is None else (np.minimum(bounds[0], lo), np.maximum(bounds[1], hi))
                elif mode == "normmean":
                    lo, hi = lo_hi
                    span = hi - lo
                    safe = np.where(span == 0, 1.0, span)
                    yield means(src, pid, np.where(span == 0, 0.0, (S - lo) / safe).mean(axis=1))      # constant target -> 0
                elif mode == "tiles":
                    for i in range(0, S.shape[1], width):
                        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(pid), pa.array(np.full(len(pid), first_block + i // width, np.int32)), arrays(S[:, i:i + width])],
                                                         names=["src", "pool_id", "block", "scores"])
                elif mode == "columns":
                    for i in range(0, len(S), width):         # pool rows of a tile
                        for one in np.unique(src[i:i + width]):
                            own = i + np.flatnonzero(src[i:i + width] == one)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(tids), pa.array(np.full(len(tids), one, np.int32)), arrays(np.tile(pid[own], (len(tids), 1))), arrays(S[own].T)],
                                names=["target_id", "src", "pool_ids", "scores"])
                elif mode == "mean":
                    yield means(src, pid, S.mean(axis=1) if S.shape[1] else np.full(len(pid), np.nan))
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(tids, len(S))), pa.array(np.repeat(src, S.shape[1])), pa.array(np.repeat(pid, S.shape[1])), pa.array(S.ravel())],
                        names=["target_id", "src", "pool_id", "score"])
        if best is not None:
            yield from emit(best.end())
        for g, held in by_group.items():
            yield from emit(held.end(), g)
        if cells is not None and cells.any():
            rows = max(1, EMIT_ROWS // bins)
            for i in range(0, len(tids), rows):
                part = cells[i * bins:(i + rows) * bins].astype(np.float64)
                lists = pa.ListArray.from_arrays(np.arange(0, len(part) + 1, bins, dtype=np.int32), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array(tids[i:i + rows]), lists], names=["target_id", "counts"])
        if bounds is not None:
            yield pa.RecordBatch.from_arrays([pa.array(tids), pa.array(bounds[0]), pa.array(bounds[1])], names=["target_id", "lo", "hi"])

    src_expr = F.col(src_col).cast("int") if src_col in pool.columns else F.lit(0).cast("int")
    slim = pool.select(src_expr.alias("src"), F.col(id_col).cast("long").alias("pool_id"), F.col(vec_col).alias("vec"), *(["grp"] if depths else []))
    return slim.mapInArrow(fn, out_schema)


def _cutoffs(pool: DataFrame, ids: np.ndarray, ids_bc, mat_bc, scale: float, *, k: int, largest: bool, **scan) -> np.ndarray:
    """For each target a key (the score, negated where the largest are wanted)
    that at least ``k`` rows of the pool reach; infinite where there are fewer.

    Every task counts its scores into bins between -scale and scale, one row per
    target; these are summed by target, and the first bin whose running total
    reaches k is found on the cluster. One number per target comes back. The
    next bin's upper edge is taken, as scores may differ in the last bit between
    two scans."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    bins = _bins(len(ids))
    counts = _scan(pool, ids_bc, mat_bc, mode="bins", k=k, largest=largest, scale=scale, **scan)
    total = counts.groupBy("target_id").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("counts")))).alias("counts"))
    begun = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("below"))
    found = F.aggregate("counts", begun, lambda a, n: F.struct((a["total"] + n).alias("total"), (a["below"] + (a["total"] + n < k).cast("int")).alias("below")))
    below = {r["target_id"]: r["below"] for r in total.select("target_id", found["below"].alias("below")).collect()}     # one row per target
    at = np.array([below.get(int(i), bins) for i in ids], np.float64)
    return np.where(at >= bins, np.inf, (at + 2) * (2 * scale / bins) - scale)


def cosine_scores(pool: DataFrame, targets, *, mode: str = "pairs", k: int = 0,
                  largest: bool = True, normalise: bool = True, pool_id: str = "pool_id",
                  src: str = "src", target_id: str = "target_id", vec: str = "vec",
                  max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, cutoff: bool | None = None) -> DataFrame:
    """Score every pool row against every target (Arrow + NumPy path).

    ``targets`` is a DataFrame (``target_id``, ``vec``) or a prepared
    :class:`TargetMatrix`. Each broadcast block holds at most
    ``max_broadcast_bytes`` of target vectors; a larger (but driver-sized)
    target set is scored block by block, one pool scan per block.
    ``mode='topk'`` returns each partition's top-k candidates; feed the result to
    :func:`topk_per_target` for the exact global per-target top-k. ``cutoff``
    says whether a histogram scan goes ahead (default: from ``CUTOFF_LEAST_K``
    on); it changes how many candidates come back, not the top-k among them.
    """
    if mode not in ("pairs", "topk", "mean", "bounds"):
        raise ValueError(mode)
    if mode == "topk" and k <= 0:
        return pool.sparkSession.createDataFrame([], SCORE_SCHEMA)
    tm = targets if isinstance(targets, (TargetMatrix, TargetBlocks)) else target_matrix(
        targets, target_id, vec, normalise, max_broadcast_bytes)
    if len(tm.ids) == 0:
        schema = SCORE_SCHEMA if mode != "mean" else "src int, pool_id bigint, score double, n_targets bigint"
        return pool.sparkSession.createDataFrame([], schema)
    if mode == "mean" and len(tm.blocks) > 1:
        n = len(tm.ids)
        return mean_scores_fused(pool, tm, pool_id=pool_id, src=src, vec=vec).withColumn("n_targets", F.lit(n).cast("long"))
    sc = pool.sparkSession.sparkContext
    scan = dict(k=k, largest=largest, normalise=normalise, vec_col=vec, src_col=src, id_col=pool_id, d=tm.d)
    ahead = mode == "topk" and (k >= CUTOFF_LEAST_K if cutoff is None else cutoff)
    longest = 1.0
    if ahead and not normalise:                            # |x . t| <= |x| |t|
        v = V.as_double(F.col(vec))
        longest = float(pool.agg(F.max(F.sqrt(V.dot(v, v)))).first()[0] or 0.0) or 1.0
    parts = []
    for ids, mat in tm.blocks:
        ids_bc, mat_bc, cut_bc = sc.broadcast(ids), sc.broadcast(mat), None
        if ahead:
            scale = 1.0 if normalise else longest * float(np.sqrt(np.einsum("ij,ij->i", mat, mat)).max() or 1.0)
            cut_bc = sc.broadcast(_cutoffs(pool, ids, ids_bc, mat_bc, scale if np.isfinite(scale) else np.finfo(np.float64).max / 4, **scan))
        parts.append(_scan(pool, ids_bc, mat_bc, mode=mode, cut_bc=cut_bc, **scan))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped_topk(pool: DataFrame, targets, depths: dict[str, int], *, group: str, largest: bool = True, normalise: bool = True, pool_id: str = "pool_id",
                 src: str = "src", vec: str = "vec") -> DataFrame:
    """``target_id, src, pool_id, score, grp, rank, more``: for every target and
    group of pool rows the best ``depths[group]`` rows, ranked (ties: earlier (src,
    pool_id)), with ``more`` if the list was longer. One scan; groups that ``depths``
    doesn't name take no part. The groups are few: a task keeps a buffer for each."""
    spark = pool.sparkSession
    tm = targets if isinstance(targets, (TargetMatrix, TargetBlocks)) else target_matrix(targets, normalise=normalise)
    found = spark.createDataFrame([], GROUPED_SCHEMA)
    if depths and len(tm.ids):
        rows = pool.withColumn("grp", F.col(group)).where(F.col("grp").isin(list(depths)))
        asked = {g: n + 1 for g, n in depths.items()}             # one more tells whether the list goes on
        for i, (ids, mat) in enumerate(tm.blocks):
            part = _scan(rows, spark.sparkContext.broadcast(ids), spark.sparkContext.broadcast(mat), mode="grouped", k=0, largest=largest, normalise=normalise,
                         vec_col=vec, src_col=src, id_col=pool_id, d=tm.d, depths=asked)
            found = part if i == 0 else found.unionByName(part)
    most = F.create_map(*[x for g, n in depths.items() for x in (F.lit(g), F.lit(n))])[F.col("grp")] if depths else F.lit(0)
    order = Window.partitionBy("target_id", "grp").orderBy(*rank_order(largest))
    deepest = max(depths.values(), default=0) + 1
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= deepest)
    ranked = ranked.withColumn("more", F.lead("rank").over(order).isNotNull() & (F.col("rank") == most))
    return ranked.where(F.col("rank") <= most)


def mean_scores_fused(pool: DataFrame, targets, normalised: bool = False, pool_id: str = "pool_id",
                      src: str = "src", target_id: str = "target_id", vec: str = "vec",
                      max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Mean cosine score of every pool row over the target set without the
    pool x target table: one Arrow scan per target block emits per-row sums.

    ``normalised`` first finds each target's min and max score in a scan that
    emits one row per (batch, target), then scales the scores to [0, 1] inside
    the second scan (a constant target scales to 0)."""
    tm = targets if isinstance(targets, (TargetMatrix, TargetBlocks)) else target_matrix(
        targets, target_id, vec, True, max_broadcast_bytes)
    if len(tm.ids) == 0:
        return pool.sparkSession.createDataFrame([], "src int, pool_id bigint, score double")
    sc = pool.sparkSession.sparkContext
    kw = dict(k=0, largest=True, normalise=True, vec_col=vec, src_col=src, id_col=pool_id, d=tm.d)
    parts = []
    for ids, mat in tm.blocks:
        ids_bc, mat_bc = sc.broadcast(ids), sc.broadcast(mat)
        if not normalised:
            parts.append(_scan(pool, ids_bc, mat_bc, mode="mean", **kw))
            continue
        b = (_scan(pool, ids_bc, mat_bc, mode="bounds", **kw).groupBy("target_id")
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect())   # one row per target
        by_id = {r["target_id"]: (r["lo"], r["hi"]) for r in b}
        lo = np.array([by_id[i][0] for i in ids])
        hi = np.array([by_id[i][1] for i in ids])
        parts.append(_scan(pool, ids_bc, mat_bc, mode="normmean", bounds_bc=sc.broadcast((lo, hi)), **kw))
    if len(parts) == 1:
        return parts[0].select("src", "pool_id", "score")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.groupBy("src", "pool_id")
            .agg((F.sum(F.col("score") * F.col("n_targets")) / F.sum("n_targets")).alias("score")))


# --------------------------------------------------------------------------
# ranking
# --------------------------------------------------------------------------

def rank_order(largest: bool):
    s = F.col("score")
    return [s.desc() if largest else s.asc(), F.col("src").asc(), F.col("pool_id").asc()]


def topk_per_target(scores: DataFrame, k: int, largest: bool = True, salt_buckets: int | None = None) -> DataFrame:
    """Exact top-k per target with a 1-based ``rank`` (ties: earlier (src, pool_id) first).

    Two window stages: first per (target, group), so one hot target spreads over
    many tasks, then per target over at most ``groups * k`` survivors. A group is
    32 neighbouring partitions, so the groups grow with the pool;
    ``salt_buckets`` sets a fixed number of hashed groups instead. Both filters
    are ``row_number() <= k`` so Spark inserts a partial group limit before each
    shuffle.
    """
    if k <= 0:
        return scores.withColumn("rank", F.lit(0)).limit(0)
    order = rank_order(largest)
    cur = scores
    if salt_buckets is None or salt_buckets > 1:
        salt = (F.floor(F.spark_partition_id() / GROUP_PARTITIONS) if salt_buckets is None
                else F.pmod(F.xxhash64("src", "pool_id"), F.lit(salt_buckets)))
        w1 = Window.partitionBy("target_id", "_salt").orderBy(*order)
        cur = (cur.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
               .filter(F.col("_rn") <= k).drop("_rn", "_salt"))
    w2 = Window.partitionBy("target_id").orderBy(*order)
    return cur.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def ip_topk_smallest(scores: DataFrame, k: int) -> DataFrame:
    """Flat inner-product search returning the k smallest products per query,
    ascending (the reference's in-memory index sorts ascending)."""
    return topk_per_target(scores, k, largest=False)
