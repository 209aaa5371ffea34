"""The most similar vectors for every vector: balanced posting lists.

A bounded sample fits the centroids, with a penalty on large lists. Every vector
goes to its nearest list and, if it lies near a border, to the lists beyond the
border too. Lists of a query are found by walking a graph over the centroids that
every task holds in memory, and are searched only while their centroid is not much
farther than the nearest. One shuffle brings vectors and queries of a list
together; a list larger than a block is searched in several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlmill.operators.skew import salted_join
from crawlmill.session import cut

#: Rows that one step of the posting gives at most, so memory follows the step and not the lists searched.
ROWS_OUT = 200_000


@dataclass(frozen=True)
class KnnSettings:
    """``sample`` vectors at most fit one centroid for every ``list_size`` vectors, at most ``most_lists`` (with their graph 25 MB).

    Lists grow beyond ``list_size`` from most_lists x list_size = 17 million vectors on,
    and are cut into blocks from most_lists x block = 268 million on.

    With a ``recall``, ``probes`` is only the least number of lists: as many are
    searched as ``probes_for`` finds to be needed for it.
    """

    dim: int = 64
    k: int = 10
    list_size: int = 256
    sample: int = 262_144
    most_lists: int = 65_536
    rounds: int = 8
    degree: int = 32
    replicas: int = 3
    closure: float = 1.1
    probes: int = 4
    prune: float = 1.2
    block: int = 4_096
    min_similarity: float = -1.0
    recall: float = 0.0


def usable_vectors(pages: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vec): unit vectors as float32 bytes, of embeddings with ``dim`` finite values that are not all zero."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.to_numpy()[good], pa.int64()), pa.array([v.tobytes() for v in unit], pa.binary())], ["id", "vec"]
            )

    whole = pages.where(
        (F.size("embedding") == dim) & F.col("id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull())
    )
    return whole.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(read, "id long, vec binary")


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def fit_centroids(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors, of balanced lists.

    A list is the less attractive the more it outgrows the mean size, and a list
    of twice that size or more is split with the centroids of small ones.
    """
    g = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c, load = x[g.choice(len(x), k, replace=False)].copy(), np.zeros(k, np.float32)
    for turn in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ c.T - load).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(best, minlength=k)
        load += 0.02 * np.log(np.maximum(size, 1) * k / len(x)).astype(np.float32)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        empty = size == 0
        total[empty] = x[g.choice(len(x), empty.sum())]
        mean = len(x) / k
        if turn < rounds - 2:
            large = [i for i in np.argsort(-size) for _ in range(int(size[i] / mean) - 1) if size[i] > 2 * mean]
            small = [i for i in np.argsort(size, kind="stable") if size[i] < mean / 2]
            for big, little in zip(large, small):
                total[little] = x[g.choice(np.flatnonzero(best == big))]
                load[little] = load[big] = 0
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def fit_tree(x: np.ndarray, k: int, rounds: int, fan: int = 256) -> np.ndarray:
    """Unit centroids as of ``fit_centroids``; beyond 4 x ``fan`` of them in two levels, so the work grows with their number and not its square."""
    if k <= 4 * fan:
        return fit_centroids(x, k, rounds)
    coarse = fit_centroids(x[:: max(1, len(x) // (64 * fan))], fan, rounds)
    cell = np.concatenate([(x[i : i + 4096] @ coarse.T).argmax(1) for i in range(0, len(x), 4096)])
    parts = [x[cell == i] for i in range(fan)]
    return np.concatenate([fit_centroids(own, max(1, round(k * len(own) / len(x))), rounds, i) for i, own in enumerate(parts) if len(own)])


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row, largest first."""
    k = min(k, sims.shape[1])
    near = np.argpartition(-sims, k - 1, 1)[:, :k]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), 1, kind="stable"), 1)


#: Vectors of the sample for each centroid.
SAMPLE_PER_LIST = 4


class CentroidGraph:
    """Nearest-neighbour graph over the centroids, and its search."""

    def __init__(self, centroids: np.ndarray, degree: int, links: np.ndarray | None = None):
        self.c = centroids
        if links is None:
            d = min(degree, len(centroids))
            links = np.concatenate(
                [_nearest(centroids[i : i + 1024] @ centroids.T, d) for i in range(0, len(centroids), 1024)]
            ).astype(np.int32)
        self.links = links  # a centroid is its own first neighbour
        # a walk begins at the nearest of about 2 * sqrt(n) entries, so it need not cross gaps between clusters
        step = max(1, int(len(centroids) / (8 + 2 * np.sqrt(len(centroids)))))
        self.entries = np.arange(0, len(centroids), step)

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, similarities) of up to ``probes`` nearest centroids found from the entry points, best first.

        A walk ends with the neighbours of three centroids at most; where more
        lists than one centroid's neighbours are wanted, all centroids are compared.
        """
        ids, sims = [], []
        find = self._walk if probes <= self.links.shape[1] else self._all
        for i in range(0, len(x), 512):
            a, b = find(x[i : i + 512], probes)
            ids.append(a)
            sims.append(b)
        return np.concatenate(ids), np.concatenate(sims)

    def _all(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        sims = x @ self.c.T
        near = _nearest(sims, probes)
        return near, np.take_along_axis(sims, near, 1).astype(np.float32)

    def _walk(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(x))[:, None]
        start = x @ self.c[self.entries].T
        front = self.entries[np.argsort(-start, 1)[:, :3]]
        best = np.full(len(x), -2.0, np.float32)
        for _ in range(12):
            near = self.links[front].reshape(len(x), -1)
            sims = np.einsum("nd,nkd->nk", x, self.c[near])
            order = np.argsort(-sims, 1)
            near, sims = near[rows, order], sims[rows, order]
            fresh = np.ones_like(near, bool)
            by_id = np.argsort(near, 1, kind="stable")
            repeat = np.zeros_like(fresh)
            sorted_ids = near[rows, by_id]
            repeat[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            fresh[rows, by_id] = ~repeat
            sims = np.where(fresh, sims, -2.0)
            order = np.argsort(-sims, 1, kind="stable")
            near, sims = near[rows, order], sims[rows, order]
            if (sims[:, 0] <= best + 1e-7).all():
                break
            best, front = sims[:, 0], near[:, :3]
        return near[:, :probes], sims[:, :probes].astype(np.float32)


def fit_graph(vectors: DataFrame, s: KnnSettings, rows: int) -> tuple[CentroidGraph, KnnSettings]:
    """Centroids of a random sample, one per ``s.list_size`` rows, and ``s`` with the probes to use.

    The sample has ``SAMPLE_PER_LIST`` vectors for each list, at least a tenth of ``s.sample``
    and at most all of it. For a ``recall`` as many vectors again are drawn, at most a
    tenth of ``s.sample``, which the centroids do not know.
    """
    lists = min(s.most_lists, max(1, -(-rows // s.list_size)))
    size = min(s.sample, max(SAMPLE_PER_LIST * lists, s.sample // 10))
    unknown = min(size, s.sample // 10) if s.recall else 0
    drawn = vectors.select("vec").sample(min(1.0, 1.05 * (size + unknown) / max(1, rows)), 9).limit(size + unknown).collect()
    x = np.frombuffer(b"".join(r[0] for r in drawn), np.float32).reshape(-1, s.dim)
    if s.recall:
        x = x[np.random.default_rng(2).permutation(len(x))]
    fitted, held = x[:size], x[size:]
    graph = CentroidGraph(fit_tree(fitted, min(lists, max(1, len(fitted) // SAMPLE_PER_LIST)), s.rounds), s.degree)
    if s.recall:
        # with less than half as many unknown vectors the lists are long, and known ones tell as much
        s = replace(s, probes=max(s.probes, probes_for(graph, held if len(held) >= unknown / 2 and len(held) else x[: s.sample // 10], s)))
    return graph, s


def probes_for(graph: CentroidGraph, x: np.ndarray, s: KnnSettings, queries: int = 512) -> int:
    """Lists to search so that ``s.recall`` of the ``s.k`` most similar of ``x`` are found, for ``queries`` of them.

    Neighbours in a sample are farther away than those in all rows, so the
    number is rather too large than too small.
    """
    step = max(1, len(x) // queries)
    at = np.arange(0, len(x), step)
    k, every = min(s.k, len(x) - 1), len(graph.c)
    if k < 1:
        return 1
    needed = []
    for i in range(0, len(at), 64):
        own = at[i : i + 64]
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -2
        near = np.argpartition(-sims, k - 1, 1)[:, :k]
        place = np.empty((len(own), every), np.int64)
        np.put_along_axis(place, np.argsort(-(x[own] @ graph.c.T), 1, kind="stable"), np.arange(every)[None], 1)
        lists, close = graph.nearest(x[near.ravel()], s.replicas)
        far = np.sqrt(np.maximum(2 - 2 * close, 0))
        stored = (close > -1.5) & (far <= s.closure * (far[:, :1] + 1e-6))
        rank = np.where(stored, place[np.repeat(np.arange(len(own)), k)[:, None], lists], every)
        needed.append(rank.min(1))
    return int(np.quantile(np.concatenate(needed), s.recall, method="higher")) + 1


def _postings(vectors: DataFrame, graph: CentroidGraph, s: KnnSettings) -> DataFrame:
    """(list, id, vec, copied, member, query): one row for each list a vector is stored in or looked up in."""
    shared = vectors.sparkSession.sparkContext.broadcast((graph.c, graph.links))

    def posted(own: CentroidGraph, batch: pa.RecordBatch, rows: np.ndarray, probes: int) -> pa.RecordBatch:
        x = _vectors(batch.column(1).take(pa.array(rows)), s.dim)
        lists, sims = own.nearest(x, max(probes, s.replicas))
        far = np.sqrt(np.maximum(2 - 2 * sims, 0))
        rank = np.arange(lists.shape[1])
        near = far[:, :1] + 1e-6
        real = sims > -1.5
        member = real & (far <= s.closure * near) & (rank < s.replicas)
        query = real & (far <= s.prune * near) & (rank < probes)
        row, col = np.nonzero(member | query)
        at = pa.array(rows[row])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(lists[row, col], pa.int32()),
                batch.column(0).take(at),
                batch.column(1).take(at),
                batch.column(3).take(at),
                pa.array(member[row, col]),
                pa.array(query[row, col]),
            ],
            ["list", "id", "vec", "copied", "member", "query"],
        )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, links = shared.value
        own = CentroidGraph(c, s.degree, links)
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for which, probes in ((~asks, 0), (asks, s.probes)):
                rows, step = np.flatnonzero(which), max(1, ROWS_OUT // max(probes, s.replicas))
                for i in range(0, len(rows), step):
                    yield posted(own, batch, rows[i : i + step], probes)

    schema = "list int, id long, vec binary, copied boolean, member boolean, query boolean"
    return vectors.select("id", "vec", "query", "copied").mapInArrow(spread, schema)


def _search(s: KnnSettings):
    def run(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), _vectors(table.column("vec"), s.dim)
        member, query = table.column("member").to_numpy(), table.column("query").to_numpy()
        m_ids, m, m_copied = ids[member], x[member], table.column("copied").to_numpy()[member]
        out_q, out_n, out_s, out_c = [], [], [], []
        if len(m):
            k = min(s.k, len(m))
            for i in range(0, int(query.sum()), 512):
                q_ids, q = ids[query][i : i + 512], x[query][i : i + 512]
                sims = q @ m.T
                sims[q_ids[:, None] == m_ids[None]] = -2
                top = np.argpartition(-sims, k - 1, 1)[:, :k]
                best = sims[np.arange(len(q))[:, None], top]
                r, c = np.nonzero(best >= s.min_similarity)
                out_q.append(q_ids[r])
                out_n.append(m_ids[top[r, c]])
                out_s.append(best[r, c])
                out_c.append(m_copied[top[r, c]])
        join = lambda a, t: pa.array(np.concatenate(a) if a else np.zeros(0), t)
        return pa.table({"id": join(out_q, pa.int64()), "other": join(out_n, pa.int64()), "similarity": join(out_s, pa.float32()), "copied": join(out_c, pa.bool_())})

    return run


def neighbours(vectors: DataFrame, s: KnnSettings = KnnSettings(), queries: str = "true") -> DataFrame:
    """(id, other, similarity): up to ``s.k`` most similar other vectors of each one that fits ``queries``.

    ``vectors`` is (id, vec) as of ``usable_vectors``. Equal vectors are
    searched once; each copy then gets the copies of what its vector found, the
    lowest ids first, so that a third of all rows may be copies of one vector.
    Equal similarities are ordered by id. An empty input gives no row.
    """
    vectors = cut(vectors)
    rows = vectors.count()
    if not rows:
        return vectors.select("id", F.col("id").alias("other"), F.lit(0).cast("float").alias("similarity")).limit(0)
    graph, s = fit_graph(vectors, s, rows)

    # copies: of each vector the k + 1 lowest ids, found in salted parts first
    keyed = vectors.select("id", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2"))
    part = Window.partitionBy("k1", "k2", "part").orderBy("id")
    whole = Window.partitionBy("k1", "k2").orderBy("id")
    groups = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(
        salted_join(keyed, groups, ["k1", "k2"], "n").select("id", "rep", "n", "k1", "k2", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part"))
    )
    lowest = (
        copies.withColumn("r", F.row_number().over(part)).where(F.col("r") <= s.k + 1)
        .withColumn("r", F.row_number().over(whole)).where(F.col("r") <= s.k + 1)
        .groupBy("rep").agg(F.first("n").alias("n"), F.collect_list("id").alias("copies"))  # k + 1 at most
    )
    lowest = cut(lowest)

    owners = copies.where(queries).select(F.col("id").alias("owner"), "rep")
    wanted = owners.groupBy("rep").agg(F.count(F.lit(1)).alias("owners"))
    reps = lowest.join(wanted, "rep", "left").select(F.col("rep").alias("id"), F.lit(True).alias("copied"), F.col("owners").isNotNull().alias("wanted"))
    singles = vectors.join(copies.where("id <> rep").select("id"), "id", "left_anti")
    asked = singles.join(reps, "id", "left").select(
        "id", "vec", F.coalesce("copied", F.lit(False)).alias("copied"), (F.expr(queries) | F.coalesce("wanted", F.lit(False))).alias("query")
    )
    posted = _postings(asked, graph, s)

    # a list larger than a block is cut into blocks; its queries visit all of them
    sizes = posted.where("member").groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.block)).cast("int").alias("blocks"))
    large = F.broadcast(cut(sizes.where("blocks > 1")))  # at most one row per list, so at most s.most_lists
    blocked = posted.join(large, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = blocked.withColumn(
        "block", F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home)))
    ).withColumn("member", F.col("member") & (F.col("block") == home))
    found = placed.select("list", "block", "id", "vec", "copied", "member", "query").groupBy("list", "block").applyInArrow(
        _search(s), "id long, other long, similarity float, copied boolean"
    )

    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    distinct = found.groupBy("id", "other").agg(F.max("similarity").alias("similarity"), F.max("copied").alias("copied"))
    between = cut(distinct.withColumn("r", F.row_number().over(best)).where(F.col("r") <= s.k).drop("r"))

    # back from vectors to their copies: k + 1 of each, so at most k * (k + 1) candidates a row
    met = between.where("copied").groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    known = met.join(lowest.select(F.col("rep").alias("other"), "copies"), "other")
    widened = salted_join(between.where("copied"), known, ["other"], "n").select("id", F.explode("copies").alias("other"), "similarity")
    targets = between.where("not copied").select("id", "other", "similarity").unionByName(widened)
    nearest = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    targets = cut(targets.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= s.k).drop("r"))

    # what a vector found goes to all its owners, with its copies as the nearest; one row a vector, so owners of one are split
    itself = lowest.select("rep", F.explode("copies").alias("other"), F.lit(1.0).cast("float").alias("similarity"))
    beyond = targets.join(wanted.withColumnRenamed("rep", "id"), "id", "left_semi").select(F.col("id").alias("rep"), "other", "similarity")
    each = F.collect_list(F.struct("other", "similarity")).alias("near")
    given = itself.unionByName(beyond).groupBy("rep").agg(each).join(wanted, "rep")
    shared = salted_join(owners, given, ["rep"], "owners").select(F.col("owner").alias("id"), F.explode("near").alias("x"))
    copied = shared.select("id", "x.*").where("id <> other")
    own = targets.join(wanted.withColumnRenamed("rep", "id"), "id", "left_anti")
    last = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    ranked = copied.withColumn("r", F.row_number().over(last)).where(F.col("r") <= s.k).drop("r")
    return own.unionByName(ranked).where(queries).select("id", "other", "similarity")


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of neighbours at least ``least`` similar, each pair once."""
    return (
        found.where(F.col("similarity") >= F.lit(least))
        .select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
        .distinct()
    )
