"""Vector similarity joins.  Distance is squared L2 everywhere and thresholds are inclusive.

Self-joins give each unordered pair once, as a_idx > b_idx.  Cross-joins give every ordered pair.
Empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import sqdist
from tessera.operators import blocks
from tessera.operators.blocks import block_join, closest, nearest, nearest_within, side, within
from tessera.operators.clustering import assign, block_of, candidates, group_rows, grouped, loaded_centroids, placed, probed, probes, reaches
from tessera.storage import saved


#: Pairs of rows up to which a nested loop is run.
NESTED = 100_000_000
#: Tiles that b rows may be dealt to.
MAX_TILES = 1_000_000


def threshold_join(a: DataFrame, b: DataFrame | None, threshold: float, rows_per_block: int | None = None) -> DataFrame:
    """All pairs within ``threshold``, exactly; ``b`` None: a with itself."""
    if b is None:
        return block_join(side(a, "a"), side(a, "b"), within(threshold), rows_per_block, triangle=True, self_join=True)
    return block_join(side(a, "a"), side(b, "b"), within(threshold), rows_per_block)


def threshold_join_native(a: DataFrame, b: DataFrame | None, threshold: float) -> DataFrame:
    """The same by a nested loop of column expressions: a cross-check for at most ``NESTED`` pairs of rows; more go the other way."""
    n = a.count()
    if n * (n if b is None else b.count()) > NESTED:
        return threshold_join(a, b, threshold)
    x, y = side(a, "a").drop("key"), side(a if b is None else b, "b").drop("key").withColumnRenamed("v", "w")
    near = sqdist("v", "w") <= threshold
    cond = (F.col("a_idx") > F.col("b_idx")) & near if b is None else near
    return x.join(y, cond).select("a_idx", "b_idx", sqdist("v", "w").alias("dist"))


def _top(pairs: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("dist", "a_idx")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(a: DataFrame, b: DataFrame | None, k: int, rows_per_block: int | None = None) -> DataFrame:
    """(b_idx, rank, a_idx, dist): each b row's ``k`` nearest a rows; a self-join leaves a row's own id out."""
    found = block_join(side(a, "a"), side(a if b is None else b, "b"), nearest(k + (b is None)), rows_per_block)
    if b is None:
        found = found.where("a_idx <> b_idx")
    return _top(found, k, "b_idx").select("b_idx", "rank", "a_idx", "dist")


def tile_of(column: str, tile_rows: int | None):
    return F.lit(0).cast("long") if tile_rows is None else F.floor(F.col(column) / tile_rows)


def dealt_to_tiles(rows: DataFrame, a: DataFrame, tile_rows: int, own_and_later: bool) -> DataFrame:
    """``rows`` once for each tile of a, in ``_tile``; ``own_and_later``: only the tiles from the row's own on.

    Tiles are ranges of ``tile_rows`` ids.  Ids without large gaps need two numbers of a; others its tiles, ``MAX_TILES`` at most.
    """
    tiles = a.select(tile_of("vec_id", tile_rows).alias("t")).where("t is not null")
    row = tiles.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.approx_count_distinct("t").alias("n")).first()
    if row["lo"] is None:
        return rows.withColumn("_tile", F.lit(0).cast("long")).limit(0)
    mine = tile_of("vec_id", tile_rows)
    if row["hi"] - row["lo"] < 2 * row["n"] + 8:
        lo, hi = F.lit(row["lo"]).cast("long"), F.lit(row["hi"]).cast("long")
        first = F.greatest(mine, lo) if own_and_later else lo
        each = F.when(first <= hi, F.sequence(first, hi))
    else:
        held = sorted(r["t"] for r in tiles.distinct().limit(MAX_TILES + 1).collect())
        if len(held) > MAX_TILES:
            raise ValueError(f"more than {MAX_TILES} tiles: use larger ones")
        each = F.array(*map(F.lit, held)).cast("array<bigint>")
        each = F.filter(each, lambda t: t >= mine) if own_and_later else each
    return rows.withColumn("_tile", F.explode(each))


def tile_knn_threshold(a: DataFrame, b: DataFrame | None, k: int, threshold: float, tile_rows: int | None = None, rows_per_block: int | None = None) -> DataFrame:
    """Each b row's ``k`` nearest in every tile of a, then those within ``threshold``, then (self-join) a_idx > b_idx.

    ``k`` counts the row itself and its mirrored neighbours, so the result depends on the tiles, which
    are ranges of ``tile_rows`` ids (None: one tile).  A self-join visits tiles not before the row's own.
    """
    other = a if b is None else b
    if tile_rows is None:
        left, right = side(a, "a"), side(other, "b")
    else:
        left = side(a.withColumn("_tile", tile_of("vec_id", tile_rows)), "a", "_tile")
        right = side(dealt_to_tiles(other, a, tile_rows, b is None), "b", "_tile")
    found = block_join(left, right, nearest(k), rows_per_block)
    best = _top(found.withColumn("_tile", tile_of("a_idx", tile_rows)), k, "b_idx", "_tile").where(F.col("dist") <= threshold)
    best = best.where("a_idx > b_idx") if b is None else best
    return best.select("a_idx", "b_idx", "dist")


def ivf_join(a: DataFrame, b: DataFrame | None, centroids: DataFrame, k: int, n_probes: int, threshold: float, rows_per_block: int | None = None, tile_rows: int | None = None) -> DataFrame:
    """Inverted lists: a rows in their nearest centroid's list; b rows look into ``n_probes`` lists.

    Then the ``k`` nearest found in each tile of a (ranges of ``tile_rows`` ids; None: one tile), the threshold, and (self-join) a_idx > b_idx.
    Ranges of lists are blocks, stored once, and the lists that a row looks into are a mask, so a row is copied for neither.
    """
    lists = saved(assign(a, centroids).select("vec_id", "embedding", F.col("centroid_id").alias("cluster")), "lists")
    n = lists.count()
    m = n if b is None else b.count()
    rows = rows_per_block or group_rows(a.sparkSession, n, m)
    places = saved(placed(grouped(lists.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), rows)), "places")
    asked = block_of(probed(a if b is None else b, centroids, n_probes, places), rows, m)
    found = block_join(side(lists.join(places, "cluster"), "a", "grp", more=("pos",)), side(asked, "b", "block", more=("bits",)), nearest_within(k, threshold, tile_rows), rows, places=True)
    found = _top(found.withColumn("_tile", tile_of("a_idx", tile_rows)), k, "b_idx", "_tile").where(F.col("dist") <= threshold)
    found = found.where("a_idx > b_idx") if b is None else found
    return found.select("a_idx", "b_idx", "dist")


#: Rows that a pair of blocks holds before it keeps each row's nearest alone.
HELD = 1 << 21


def _hits_of(x: pa.Table, y: pa.Table, same: bool, k: int, threshold: float, c: np.ndarray) -> pa.Table:
    """Of two blocks of ``reaches`` (a block with itself: ``same``): the ``k`` nearest that each row finds (a_idx, b_idx, dist), and a row with the number ``n`` of distinct pairs within the threshold.

    ``c``: centroids, a column each.
    """
    ends = []
    for t in (x, y):
        ids, v = blocks._matrix(t, "vec_id")
        _, at, times = np.unique(ids, return_inverse=True, return_counts=True)
        ends.append((ids, v, np.ascontiguousarray(v.T), *(t.column(name).to_numpy() for name in ("own", "reach", "last")), times[at] > 1))

    def looks(end: tuple, i: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether rows look into lists."""
        d = np.zeros(len(i))
        for p, q in zip(end[2], c):
            z = p[i] - q[lists]
            d += z * z
        reach = end[4][i]
        return (d < reach) | ((d == reach) & (lists <= end[5][i]))

    def kept() -> list[np.ndarray]:
        a_idx, b_idx, dist = map(np.concatenate, zip(*held))
        top = blocks.first_of(b_idx, k, dist, a_idx)
        return [a_idx[top], b_idx[top], dist[top]]

    one, other = ends
    n, twice, known = 0, [np.zeros((0, 2), np.int64)], {}
    held = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
    rows = max(1, blocks.STRIP // max(1, len(one[0])))
    near = within(threshold)
    for lo in range(0, len(other[0]), rows):
        i, j, d = near(blocks.Tile(one[0], one[1], other[0][lo : lo + rows], other[1][lo : lo + rows], known=known))
        j = j + lo
        pair = one[0][i] > other[0][j] if same else np.ones(len(i), bool)
        again = pair & (one[-1][i] | other[-1][j])  # of ids that rows share: a pair counts once
        n += np.count_nonzero(pair) - np.count_nonzero(again)
        if again.any():
            twice.append(np.unique(np.column_stack([one[0][i[again]], other[0][j[again]]]), axis=0))
        for (p, i_p), (q, i_q) in [((one, i), (other, j)), ((other, j), (one, i))][: 1 if same else 2]:
            ok = looks(q, i_q, p[3][i_p])
            held.append([p[0][i_p[ok]], q[0][i_q[ok]], d[ok]])
        if sum(len(h[0]) for h in held) > HELD:
            held = [kept()]
    n += len(np.unique(np.concatenate(twice), axis=0))
    a_idx, b_idx, dist = kept()
    found = pa.table({"a_idx": a_idx, "b_idx": b_idx, "dist": dist, "n": pa.nulls(len(dist), pa.int64())})
    count = pa.table({**{f: pa.nulls(1, found.schema.field(f).type) for f in ("a_idx", "b_idx", "dist")}, "n": pa.array([n], pa.int64())})
    return pa.concat_tables([found, count])


def ivf_hits(a: DataFrame, centroids: DataFrame, k: int, n_probes: int, threshold: float, rows_per_block: int | None = None) -> DataFrame:
    """One row: n_truth, the distinct pairs of the exact self-join, and n_found, those of them that ``ivf_join`` finds, in one pass over all pairs.

    Both joins measure the same pairs, and what inverted lists find is part of the exact result: so each pair of rows is measured once, those within the threshold
    count, and each end that looks into the other's list ranks it.  A pair of blocks gives its count and each row's ``k`` nearest, so what leaves it does
    not grow with copies.  With centroids too many to send, the joins run one after the other.
    """
    loaded = loaded_centroids(centroids)
    if loaded is None:
        truth = threshold_join(a, None, threshold, rows_per_block).select("a_idx", "b_idx").distinct()
        hits = ivf_join(a, None, centroids, k, n_probes, threshold, rows_per_block).select("a_idx", "b_idx").distinct().withColumn("hit", F.lit(1))
        return truth.join(hits, ["a_idx", "b_idx"], "left").agg(F.count(F.lit(1)).alias("n_truth"), F.count("hit").alias("n_found"))
    spark, n = a.sparkSession, a.count()
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(loaded[1].T))
    n_blocks = max(1, -(-n // (rows_per_block or group_rows(spark, n, n))))
    met = blocks.block_pairs(reaches(a, loaded, n_probes), n_blocks, lambda x, y, same: _hits_of(x, y, same, k, threshold, sent.value), "a_idx long, b_idx long, dist double, n long")
    found = saved(met, "found")
    hits = _top(found.where("n is null").select("a_idx", "b_idx", "dist"), k, "b_idx").where("a_idx > b_idx").select("a_idx", "b_idx").distinct()
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_truth")).crossJoin(hits.agg(F.count(F.lit(1)).alias("n_found")))


def centroid_join(a: DataFrame, b: DataFrame | None, centroids: DataFrame, k_db: int, threshold: float, n_probes: int | None = None, rows_per_block: int | None = None, tile_rows: int | None = None) -> DataFrame:
    """b rows at their nearest centroid meet that centroid's ``k_db`` nearest rows of each tile of a; pairs within ``threshold``.

    ``n_probes``: the centroids' candidates are searched in inverted lists instead of exactly.  Tiles are ranges of ``tile_rows`` ids (None: one tile).
    """
    tiled = None if tile_rows is None else "_tile"
    near = candidates(a if tiled is None else a.withColumn(tiled, tile_of("vec_id", tile_rows)), centroids, k_db, n_probes, tiled)
    rows = a.join(near.select(F.col("a_idx").alias("vec_id"), "centroid_id"), "vec_id")
    members = assign(a if b is None else b, centroids)
    return block_join(side(rows, "a", "centroid_id"), side(members, "b", "centroid_id"), within(threshold), rows_per_block, self_join=b is None)


def closest_pairs(a: DataFrame, b: DataFrame | None, k: int = 10, ordered: bool = False, least: float | None = None, rows_per_block: int | None = None) -> DataFrame:
    """The ``k`` closest pairs of all, by (dist, b_idx, a_idx).

    ``ordered``: a self-join gives both directions of a pair.  ``least``: pairs not farther than this
    are left out (it also leaves out true duplicates); otherwise only a row with itself is.
    """
    one_way = b is None and not ordered

    def usable(t, i, j, x):
        ok = t.a[i] > t.b[j] if one_way else t.a[i] != t.b[j] if b is None else x >= 0
        return ok & (x > least) if least is not None else ok

    found = block_join(side(a, "a"), side(a if b is None else b, "b"), closest(k, usable), rows_per_block)
    return found.orderBy("dist", "b_idx", "a_idx").limit(k)


def closest_pairs_ivf(a: DataFrame, b: DataFrame | None, centroids: DataFrame, k: int = 10, n_probes: int = 64, least: float | None = 1e-4) -> DataFrame:
    """``closest_pairs`` (ordered) over inverted-list candidates."""
    lists = side(assign(a, centroids), "a", "centroid_id")
    asked = side(probes(a if b is None else b, centroids, n_probes), "b", "centroid_id")
    return _closest_of(lists, asked, b is None, k, least)


def closest_pairs_centroid(a: DataFrame, b: DataFrame | None, centroids: DataFrame, k: int = 10, n_probes: int = 1, k_db: int = 25_000, least: float | None = 1e-4) -> DataFrame:
    """``closest_pairs`` (ordered) over each probed centroid's ``k_db`` nearest rows; a pair found in several counts once."""
    near = candidates(a, centroids, k_db)
    rows = a.join(near.select(F.col("a_idx").alias("vec_id"), "centroid_id"), "vec_id")
    asked = side(probes(a if b is None else b, centroids, n_probes), "b", "centroid_id")
    return _closest_of(side(rows, "a", "centroid_id"), asked, b is None, k, least)


def _closest_of(left: DataFrame, right: DataFrame, same: bool, k: int, least: float | None) -> DataFrame:
    def usable(t, i, j, x):
        ok = t.a[i] != t.b[j] if same else x >= 0
        return ok & (x > least) if least is not None else ok

    found = block_join(left, right, closest(k, usable))
    return found.dropDuplicates(["b_idx", "a_idx"]).orderBy("dist", "b_idx", "a_idx").limit(k)
