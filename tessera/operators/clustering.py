"""Centroids: sampling, fitting, assignment, balanced clusters, schedules and pruning.

Centroids are a small table (centroid_id, centroid).  What is sent to the executors is
that table alone, and only up to ``MAX_SENT`` bytes; larger ones are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import sqdist
from tessera.operators.blocks import FEWEST, PAIR_KEY, block_join, block_rows, nearest, side, within
from tessera.storage import new_path, saved

MAX_SENT = 256 << 20
#: Rows that a balanced assignment serves in one task; more are served in ranges of their order, one after another.
RANKED_AT_ONCE = 1_000_000
_ROWS = 2048
#: Rows a cluster from which the first centers of k-means are drawn, clusters up to which that is done, and bytes of sums that tasks send to the driver as they are.
DRAWN, SPREAD = 4, 2048
SUMS_SENT = 64 << 20


def sample_exact(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) by least hash of the id: the same rows on every run."""
    return vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n)


def sample_size(rows: int, n_clusters: int, fraction: float) -> int:
    return min(rows, max(n_clusters, int(rows * fraction)))


def shuffled(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in a seeded order (a distributed sort by hash): the same on every run, however the input is partitioned."""
    return vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id")


def fit_kmeans(vectors: DataFrame, n_clusters: int, fraction: float = 1.0, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(centroid_id, centroid); never more clusters than rows, and as many as the fit returns.

    Lloyd's iterations over all drawn rows, each one pass in which a task returns a sum for each cluster.  The first centers are rows, drawn by k-means++ from
    ``DRAWN`` rows a cluster; of more than ``SPREAD`` clusters, they are just different rows.
    """
    rows = vectors.where("vec_id is not null and embedding is not null")
    n = rows.count()
    spark = vectors.sparkSession
    schema = "centroid_id int, centroid array<double>"
    if not n:
        return spark.createDataFrame([], schema)
    drawn = sample_exact(rows, sample_size(n, n_clusters, fraction), seed) if fraction < 1 else rows
    k = min(n_clusters, n)
    if k == 1:
        mean = drawn.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x")).orderBy("d")
        return spark.createDataFrame([(0, [r["x"] for r in mean.collect()])], schema)
    # by ids, so that the parts and their sums do not depend on how the input is split
    parts = spark.sparkContext.defaultParallelism
    data = saved(drawn.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).repartition(parts, "vec_id").sortWithinPartitions("vec_id"), "drawn")
    first = sample_exact(data, k * DRAWN if k <= SPREAD else k, seed).select("v").collect()
    centers = np.array([r["v"] for r in first])
    centers = _spread(centers, k, np.random.default_rng(seed)) if k <= SPREAD else np.unique(centers, axis=0)
    for _ in range(max_iter):
        n_rows, total = _sums(data, centers)
        held = n_rows > 0
        new = np.where(held[:, None], total / np.maximum(n_rows, 1)[:, None], centers)
        moved = np.sqrt(((new - centers) ** 2).sum(axis=1)).max()
        centers = new
        if not moved > 1e-4:
            break
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], schema)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` different rows of ``x`` (all, if fewer), each drawn by its squared distance from those before it."""
    picked = [int(rng.integers(len(x)))]
    d = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k and d.max() > 0:
        picked.append(int(np.searchsorted(np.cumsum(d), rng.random() * d.sum(), side="right").clip(0, len(x) - 1)))
        if not d[picked[-1]] > 0:  # rounding
            picked[-1] = int(d.argmax())
        d = np.minimum(d, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _sums(data: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of the rows nearest to each center; where tasks' sums are many, they are added up before they reach the driver."""
    sent = data.sparkSession.sparkContext.broadcast((centers, (centers * centers).sum(axis=1)))
    width = max(1, _ROWS * 1024 // len(centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, norms = sent.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for b in batches:
            for lo in range(0, b.num_rows, width):
                part = b.column(0).slice(lo, width)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                near = (norms - 2 * (x @ c.T)).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                ids, starts = np.unique(near[order], return_index=True)
                total[ids] += np.add.reduceat(x[order], starts)
                n += np.bincount(near, minlength=len(c))
        at = np.flatnonzero(n)
        ends = pa.array(np.arange(len(at) + 1) * c.shape[1], pa.int32())
        sums = pa.ListArray.from_arrays(ends, pa.array(total[at].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64()), sums], names=["k", "n", "v"])

    def add(t: pa.Table) -> pa.Table:
        ids, n, total = _added(t)
        ends = pa.array(np.arange(len(ids) + 1) * total.shape[1], pa.int32())
        return pa.table({"k": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "v": pa.ListArray.from_arrays(ends, pa.array(total.ravel()))})

    schema = "k long, n long, v array<double>"
    found = data.select("v").mapInArrow(run, schema)
    tasks = data.sparkSession.sparkContext.defaultParallelism
    if tasks * centers.nbytes > SUMS_SENT:
        found = found.groupBy(F.pmod("k", F.lit(tasks))).applyInArrow(add, schema)
    ids, n, total = _added(found.toArrow())
    sent.destroy()
    counts, sums = np.zeros(len(centers), np.int64), np.zeros(centers.shape)
    counts[ids], sums[ids] = n, total
    return counts, sums


def _added(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, n, v) added up by k, whatever the order of the rows."""
    t = t.combine_chunks()
    k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
    v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
    order = np.lexsort((*v.T[:1], n, k))
    ids, starts = np.unique(k[order], return_index=True)
    return ids, np.add.reduceat(n[order], starts), np.add.reduceat(v[order], starts)


def _load(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix of the centroids; None if they are too many to send."""
    first = centroids.select(F.size("centroid").alias("d")).first()
    if not first or centroids.count() * first["d"] * 8 > MAX_SENT:
        return None
    rows = centroids.select(F.col("centroid_id").cast("int").alias("i"), F.col("centroid").cast("array<double>").alias("v")).orderBy("i").collect()
    return np.array([r["i"] for r in rows], np.int32), np.array([r["v"] for r in rows])


def loaded_centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix of the finite centroids, by id; None if there are none or too many to send."""
    loaded = _load(centroids)
    if loaded is None:
        return None
    ok = np.isfinite(loaded[1]).all(axis=1)
    return (loaded[0][ok], loaded[1][ok]) if ok.any() else None


def _exact(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for d in range(x.shape[1]):
        y = x[i, d] - c[j, d]
        out += y * y
    return out


def rank_centroids(vectors: DataFrame, centroids: DataFrame, n: int, column: str = "ranked") -> DataFrame:
    """``vectors`` with an array of the ``n`` nearest (dist, centroid_id), nearest first, ties to the smaller id."""
    kind = T.ArrayType(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("centroid_id", T.IntegerType())]))
    rows = vectors.where("vec_id is not null and embedding is not null")
    loaded = _load(centroids)
    if loaded is None:
        c = centroids.select(F.col("centroid_id").cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
        found = block_join(side(c, "a"), side(rows, "b"), nearest(n)).groupBy("b_idx").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("dist", F.col("a_idx").cast("int").alias("centroid_id")))), 1, n).alias(column)
        )
        return rows.join(found.withColumnRenamed("b_idx", "vec_id"), "vec_id", "left").select(*rows.columns, column)
    sent = vectors.sparkSession.sparkContext.broadcast(loaded)
    at, double = len(rows.columns), rows.withColumn("_v", F.col("embedding").cast("array<double>"))
    out = pa.list_(pa.struct([("dist", pa.float64()), ("centroid_id", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = sent.value
        k = min(n, len(ids))
        norms = (c * c).sum(axis=1)
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                x = part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                d = norms[None, :] - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
                eps = (np.abs(d).max(initial=0) + norms.max(initial=0)) * 1e-12 + 1e-12
                kth = np.partition(d, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero(d <= kth[:, None] + eps)
                dist = _exact(x, c, i, j)
                order = np.lexsort((ids[j], dist, i))
                i, j, dist = i[order], j[order], dist[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                flat = pa.StructArray.from_arrays([pa.array(dist[keep]), pa.array(ids[j[keep]])], names=["dist", "centroid_id"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], lists.cast(out)], names=[*part.schema.names[:at], column])

    return double.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, kind)]))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` with their nearest centroid: centroid_id and centroid_dist."""
    ranked = rank_centroids(vectors, centroids, 1, "_near").where(F.size("_near") > 0)
    return ranked.select("*", F.col("_near")[0]["centroid_id"].alias("centroid_id"), F.col("_near")[0]["dist"].alias("centroid_dist")).drop("_near")


def probes(vectors: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """``vectors`` once for each of their ``n`` nearest centroids: centroid_id, centroid_dist, probe (from 1)."""
    ranked = rank_centroids(vectors, centroids, n, "_near")
    return ranked.select("*", F.posexplode("_near").alias("_p", "_e")).select(
        *vectors.columns, F.col("_e")["centroid_id"].alias("centroid_id"), F.col("_e")["dist"].alias("centroid_dist"), (F.col("_p") + 1).alias("probe")
    )


def block_of(vectors: DataFrame, rows: int, n: int | None = None) -> DataFrame:
    """``vectors`` (``n`` of them) with ``block``: by a hash of the id, for about ``rows`` rows each."""
    n = vectors.count() if n is None else n
    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // rows)))))


def group_rows(spark, n: int, m: int) -> int:
    """Rows of the clusters that share a key, and of a block that meets them, for sides of ``n`` and ``m`` rows."""
    return max(FEWEST, block_rows(spark, n, m) // 2)


def grouped(sizes: DataFrame, rows: int) -> DataFrame:
    """(cluster, grp, pos), stored, of ``sizes`` (cluster, n): ranges of clusters with about ``rows`` rows, and a cluster's place in its range.

    Ranges are of the ids, so uneven ones may hold more; a join cuts these into blocks.
    """
    row = sizes.agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.sum("n").alias("n")).first()
    lo, span, n = row["lo"] or 0, (row["hi"] or 0) - (row["lo"] or 0) + 1, row["n"] or 0
    grp = F.floor((F.col("cluster").cast("long") - lo) * -(-n // rows) / span).cast("long")
    dealt = sizes.select("cluster", grp.alias("grp"))
    return saved(dealt.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy("cluster")) - 1), "groups")


def _packed(places: DataFrame) -> DataFrame:
    """``places``, whose last column is an array of places, with these as ``bits``."""
    name = places.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, out = b.column(b.num_columns - 1), []
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in zip(ends[:-1], ends[1:]):
                held = np.zeros(int(flat[lo:hi].max()) + 1, np.uint8)
                held[flat[lo:hi]] = 1
                out.append(np.packbits(held, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "bits"])

    return places.mapInArrow(run, T.StructType([*(f for f in places.schema.fields if f.name != name), T.StructField("bits", T.BinaryType())]))


def placed(groups: DataFrame) -> DataFrame:
    """``groups`` with places among the clusters of all ranges: those of a range begin with a byte."""
    starts, at = [], 0
    for r in groups.groupBy("grp").agg(F.max("pos").alias("last")).orderBy("grp").collect():
        starts.append((r["grp"], at))
        at += (r["last"] // 8 + 1) * 8
    known = groups.sparkSession.createDataFrame(starts, "grp long, start int")
    return groups.join(F.broadcast(known), "grp").select("cluster", "grp", (F.col("pos") + F.col("start")).cast("int").alias("pos"))


def met_places(scheduled: DataFrame, places: DataFrame) -> DataFrame:
    """(cluster, bits) of cluster pairs (i, j): for a cluster j, the places of all i that it meets."""
    met = scheduled.select("i", "j").join(places.select(F.col("cluster").alias("i"), "pos"), "i")
    return _packed(met.groupBy(F.col("j").alias("cluster")).agg(F.collect_list("pos").alias("places")))


def met_groups(scheduled: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster, grp, bits) of cluster pairs (i, j) and the groups of the i: for a cluster j, the places in each group that it meets."""
    places = scheduled.select("i", "j").join(groups.withColumnRenamed("cluster", "i"), "i").select(F.col("j").alias("cluster"), "grp", "pos")
    return _packed(places.groupBy("cluster", "grp").agg(F.collect_list("pos").alias("places")))


def probed(vectors: DataFrame, centroids: DataFrame, n: int, places: DataFrame) -> DataFrame:
    """(vec_id, embedding, bits): rows with the places of the lists of their ``n`` nearest centroids (ties to the smaller id); of centroids without a list there are none."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    loaded = _load(centroids)
    if loaded is None:
        found = probes(rows, centroids, n).join(places, F.col("centroid_id") == F.col("cluster")).groupBy("vec_id").agg(F.collect_list("pos").alias("places"))
        return rows.join(_packed(found), "vec_id")
    ids, c = loaded
    at = {r["cluster"]: r["pos"] for r in places.select("cluster", "pos").collect()}
    place = np.array([at.get(i, -1) for i in ids.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((ids, c, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, place = sent.value
        k, norms, listed = min(n, len(ids)), (c * c).sum(axis=1), place >= 0
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                d = norms[None, :] - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
                eps = (np.abs(d).max(initial=0) + norms.max(initial=0)) * 1e-12 + 1e-12
                kth = np.partition(d, k - 1, axis=1)[:, k - 1, None]
                near = d < kth - eps
                i, j = np.nonzero(np.abs(d - kth) <= eps)  # which of these is settled by exact distances
                order = np.lexsort((ids[j], _exact(x, c, i, j), i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < (k - near.sum(axis=1))[i]
                near[i[keep], j[keep]] = True
                held = np.zeros((part.num_rows, int(place.max(initial=0)) + 1), np.uint8)
                held[:, place[listed]] = near[:, listed]
                bits = np.packbits(held, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([r.tobytes() for r in bits], pa.binary())], names=["vec_id", "embedding", "bits"])

    schema = T.StructType([*rows.schema.fields, T.StructField("bits", T.BinaryType())])
    return rows.withColumn("_v", F.col("embedding").cast("array<double>")).mapInArrow(run, schema)


def reaches(vectors: DataFrame, loaded: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """(vec_id, v, own, reach, last): finite rows with the place of their nearest centroid (ties to the smaller id), and the distance and place of the ``n``th nearest.

    A row looks into a list if (distance, place) of its centroid is not above (reach, last), so lists need not be written down row by row.  ``loaded``: finite centroids, by id.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sent, width = spark.sparkContext.broadcast(loaded[1]), max(1, _ROWS * 256 // len(loaded[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        k, norms = min(n, len(c)), (c * c).sum(axis=1)

        def first(x: np.ndarray, near: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Place and distance of each row's nearest but ``before`` of those in ``near``."""
            i, j = np.nonzero(near)
            d = _exact(x, c, i, j)
            order = np.lexsort((j, d, i))
            at = order[np.searchsorted(i, np.arange(len(x))) + before]
            return j[at], d[at]

        for b in batches:
            for lo in range(0, b.num_rows, width):
                part = b.slice(lo, width)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                ok = np.isfinite(x).all(axis=1)
                part, x = part.filter(pa.array(ok)), x[ok]
                if not len(x):
                    continue
                own = norms - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
                eps = (np.abs(own).max(initial=0) + norms.max(initial=0)) * 1e-12 + 1e-12
                kth = np.partition(own, k - 1, axis=1)[:, k - 1, None]
                last, reach = first(x, np.abs(own - kth) <= eps, k - 1 - (own < kth - eps).sum(axis=1))
                own, _ = first(x, own <= own.min(axis=1)[:, None] + eps, np.zeros(len(x), np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), pa.array(reach), pa.array(last, pa.int32())], names=["vec_id", "v", "own", "reach", "last"])

    # dealt anew: a file may be one task's
    return rows.repartition(2 * spark.sparkContext.defaultParallelism, "vec_id").mapInArrow(run, "vec_id long, v array<double>, own int, reach double, last int")


def candidates(vectors: DataFrame, centroids: DataFrame, k: int, n_probes: int | None = None, within: str | None = None) -> DataFrame:
    """(centroid_id, rank, a_idx, dist): each centroid's ``k`` nearest vectors.

    ``n_probes``: searched only in the inverted lists of the centroid's ``n_probes`` nearest centroids.
    ``within``: a column of ``vectors`` (a tile, a cluster: numbers under 2**31); each of its values has its own ``k`` nearest, and comes first in the result.
    """
    c = centroids.select(F.col("centroid_id").cast("long").alias("vec_id"), F.col("centroid").cast("array<double>").alias("embedding"))
    part = F.lit(0) if within is None else F.col(within)
    rows = vectors.withColumn("_part", part.cast("long"))
    row = rows.agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).first() if within is not None else {"lo": 0, "hi": 0}
    if n_probes is not None:
        rows, c = assign(rows, centroids), probes(c, centroids, n_probes)
    lists = F.lit(0) if n_probes is None else F.col("centroid_id")
    asked = c.withColumn("_part", F.explode(F.sequence(F.lit(row["lo"] or 0).cast("long"), F.lit(row["hi"] or 0).cast("long"))))
    if within is None and n_probes is None:
        found = block_join(side(rows, "a"), side(c, "b"), nearest(k)).withColumn("_part", F.lit(0).cast("long"))
    else:
        left, right = (x.withColumn("_key", F.col("_part") * PAIR_KEY + lists) for x in (rows, asked))
        found = block_join(side(left, "a", "_key"), side(right, "b", "_key"), nearest(k), keep_key=True).withColumn("_part", F.floor(F.col("key") / PAIR_KEY))
    w = Window.partitionBy("_part", "b_idx").orderBy("dist", "a_idx")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = top.select("_part", F.col("b_idx").cast("int").alias("centroid_id"), "rank", "a_idx", "dist")
    return out.drop("_part") if within is None else out.withColumnRenamed("_part", within)


def centroid_distances(centroids: DataFrame) -> DataFrame:
    """(i, j, centroid_dist) of all centroid pairs."""
    c = centroids.select(F.col("centroid_id").alias("vec_id"), F.col("centroid").alias("embedding"))
    kind = centroids.schema["centroid_id"].dataType
    found = block_join(side(c, "a"), side(c, "b"), within(float("inf")))
    return found.select(F.col("a_idx").cast(kind).alias("i"), F.col("b_idx").cast(kind).alias("j"), F.col("dist").alias("centroid_dist"))


def radii(clustered: DataFrame, centroids: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, radius): the greatest distance (not squared) of a member from its cluster's centroid."""
    c = centroids.select(F.col("centroid_id").alias(cluster), F.col("centroid").alias("_c"))
    return clustered.join(c, cluster).groupBy(cluster).agg(F.sqrt(F.max(sqdist("embedding", "_c"))).alias("radius"))


def schedule(centroids: DataFrame, limit: float | None, self_join: bool, radius: DataFrame | None = None, radius_b: DataFrame | None = None) -> DataFrame:
    """(i, j, centroid_dist) of the cluster pairs to join; a self-join lists j >= i only.

    With ``radius`` (a table of ``radii``) no pair within the threshold ``limit`` is lost: a pair goes only if its
    centroids are farther apart than both radii and the threshold's root together (triangle inequality).
    Without, pairs go whose centroids are farther apart than ``limit``, whatever their size.  None keeps all.
    """
    pairs = centroid_distances(centroids)
    pairs = pairs.where("j >= i") if self_join else pairs
    if limit is None:
        return pairs
    if radius is None:
        return pairs.where(F.col("centroid_dist") <= limit)
    other = radius if radius_b is None else radius_b
    r = radius.select(F.col("cluster").alias("i"), F.col("radius").alias("ri"))
    s = other.select(F.col("cluster").alias("j"), F.col("radius").alias("rj"))
    gap = F.sqrt("centroid_dist") - F.col("ri") - F.col("rj")
    return pairs.join(r, "i").join(s, "j").where(F.greatest(gap, F.lit(0.0)) <= F.sqrt(F.lit(limit)) + 1e-9).select("i", "j", "centroid_dist")


def possible_tiles(k: int, self_join: bool) -> int:
    return k * (k + 1) // 2 if self_join else k * k


def prune_ratio(scheduled: DataFrame, n_centroids: int, self_join: bool) -> DataFrame:
    """One row: scheduled, possible, prune_ratio."""
    n = possible_tiles(n_centroids, self_join)
    return scheduled.agg(F.count(F.lit(1)).alias("scheduled")).select(
        "scheduled", F.lit(n).cast("long").alias("possible"), (F.lit(1.0) - F.col("scheduled") / F.lit(float(max(1, n)))).alias("prune_ratio")
    )


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: n_clusters and the min, max and mean of their sizes."""
    return clustered.groupBy(cluster).count().agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("count").alias("min_size"), F.max("count").alias("max_size"), F.avg("count").alias("mean_size")
    )


def _ranges(asked: DataFrame) -> DataFrame:
    """``asked`` dealt by ranges of (cluster, first, vec_id), with the range as ``piece``: a cluster that many rows ask for spans several tasks."""
    return asked.repartitionByRange("cluster", "first", "vec_id").withColumn("piece", F.spark_partition_id())


def _beyond(asked: DataFrame, capacity: int) -> DataFrame:
    """(cluster, piece, before) of stored ``_ranges`` that hold rows beyond their cluster's first ``capacity``; ``before``: its rows in earlier pieces."""
    sizes = asked.groupBy("cluster", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("cluster").orderBy("piece")) - F.col("n")
    return sizes.withColumn("before", before).where(F.col("before") + F.col("n") > capacity).drop("n")


def _over(asked: DataFrame, beyond: DataFrame, capacity: int) -> DataFrame:
    """``asked`` with ``over``: whether its cluster has ``capacity`` rows before this one.  Only the piece of a cluster in which the places run out is ranked."""
    known = asked.join(beyond, ["cluster", "piece"], "left")
    w = Window.partitionBy("cluster", "piece").orderBy("first", "vec_id")
    edge = known.where(F.col("before") < capacity).withColumn("over", F.col("before") + F.row_number().over(w) > capacity)
    rest = known.where(F.col("before").isNull() | (F.col("before") >= capacity)).withColumn("over", F.col("before").isNotNull())
    return edge.unionByName(rest)


def balanced_assign(vectors: DataFrame, centroids: DataFrame, choices: int = 10) -> DataFrame:
    """``vectors`` with ``cluster``, at most ceil(rows / clusters) a cluster.

    Rows rank their ``choices`` nearest centroids, and behind them all clusters by id.  Rows nearer to their
    first choice are served first (ties: smaller vec_id), one by one: a row gets the first cluster of its ranking with a place left.
    Serving needs of a row its few choices, and of the rows before it only the places they left, a number a cluster.  So rows are ranked and put in order by all tasks, and
    served in ranges of the order of about ``RANKED_AT_ONCE`` rows, a task each; a range starts with the places that the one before it left.
    """
    spark = vectors.sparkSession
    ids = sorted(r["centroid_id"] for r in centroids.select("centroid_id").collect())
    rows = vectors.where("vec_id is not null and embedding is not null")
    n = rows.count()
    if not n or not ids:
        return vectors.limit(0).withColumn("cluster", F.lit(None).cast("int"))
    capacity = -(-n // len(ids))
    ranked = rank_centroids(rows, centroids, min(choices, len(ids)))
    state = ranked.select("vec_id", F.col("ranked")[0]["dist"].alias("first"), F.transform("ranked", lambda e: e["centroid_id"]).alias("wish"))
    if n <= RANKED_AT_ONCE:
        return rows.join(saved(_served(state, ids, [capacity] * len(ids)), "balanced"), "vec_id")
    dealt = saved(_ranges(state.withColumn("cluster", F.lit(0))), "ordered")
    path, room = new_path(spark, "balanced"), [capacity] * len(ids)
    for lo, hi in _spans(dealt):
        part = f"{path}/first={lo}"
        got = saved(_served(dealt.where(F.col("piece").between(lo, hi)).drop("cluster", "piece"), ids, room), "balanced", part)
        taken = {r["cluster"]: r["count"] for r in got.groupBy("cluster").count().collect()}
        room = [k - taken.get(c, 0) for c, k in zip(ids, room)]
    placed = spark.read.schema(T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType())])).parquet(f"{path}/*")
    return rows.join(placed, "vec_id")


def _spans(dealt: DataFrame) -> list[tuple[int, int]]:
    """Neighbouring pieces put together while they have at most ``RANKED_AT_ONCE`` rows."""
    out, held = [], 0
    for r in dealt.groupBy("piece").count().orderBy("piece").collect():
        if out and held + r["count"] <= RANKED_AT_ONCE:
            out[-1], held = (out[-1][0], r["piece"]), held + r["count"]
        else:
            out.append((r["piece"], r["piece"]))
            held = r["count"]
    return out


def _served(state: DataFrame, ids: list[int], room: list[int]) -> DataFrame:
    """(vec_id, cluster) of (vec_id, first, wish), served in one task in order of (first, vec_id) from ``room`` places in the clusters ``ids`` (ascending)."""
    sent = state.sparkSession.sparkContext.broadcast((ids, room))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, room = sent.value
        left, low = dict(zip(ids, room)), 0
        for b in batches:
            out = []
            for wish in b.column("wish").to_pylist():
                for k in wish:
                    if left[k]:
                        break
                else:
                    while not left[ids[low]]:
                        low += 1
                    k = ids[low]
                left[k] -= 1
                out.append(k)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.int32())], names=["vec_id", "cluster"])

    ordered = state.select("vec_id", "first", "wish").repartition(1).sortWithinPartitions("first", "vec_id")
    return ordered.mapInArrow(run, T.StructType([state.schema["vec_id"], T.StructField("cluster", T.IntegerType())]))


def cluster_join(a: DataFrame, b: DataFrame | None, scheduled: DataFrame, kernel, rows_per_block: int | None = None) -> DataFrame:
    """Runs a block kernel on the scheduled cluster pairs; ``a`` and ``b`` carry ``cluster``.

    In a self-join a row is in one cluster and each pair of clusters is scheduled once, so pairs are found once; they come out as a_idx > b_idx.
    Under a kernel that judges each pair by itself, ranges of clusters are blocks, stored once, and the schedule is a mask: a row is not copied for the clusters that its own one meets.
    """
    if getattr(kernel, "pairwise", False):
        keep = ("vec_id", "embedding", "cluster")
        a = saved(a.select(*keep), "clustered")
        other = a if b is None else saved(b.select(*keep), "clustered")
        rows = rows_per_block or group_rows(a.sparkSession, a.count(), other.count())
        places = saved(placed(grouped(a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), rows)), "places")
        met = saved(met_places(scheduled, places), "met")
        held = a.join(places, "cluster")
        if b is None:
            held = held.join(met, "cluster", "left").withColumn("bits", F.coalesce("bits", F.lit(bytearray())))
            both = side(held, "a", "grp", more=("pos", "bits", "cluster"))
            return block_join(both, both, kernel, rows, cluster_pairs=True, places=True)
        asked = block_of(other, rows).join(met, "cluster")
        return block_join(side(held, "a", "grp", more=("pos", "cluster")), side(asked, "b", "block", more=("bits", "cluster")), kernel, rows, places=True)
    tiles = scheduled.select("i", "j").withColumn("key", F.col("i").cast("long") * PAIR_KEY + F.col("j"))
    left = a.join(tiles, F.col("cluster") == F.col("i")).drop("cluster")
    right = (a if b is None else b).join(tiles, F.col("cluster") == F.col("j")).drop("cluster")
    return block_join(side(left, "a", "key"), side(right, "b", "key"), kernel, rows_per_block, cluster_pairs=b is None)
