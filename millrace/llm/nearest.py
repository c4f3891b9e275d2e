"""Nearest neighbours by inner product: vantage-point trees, one for each shard.

Shards are regions: sampled vectors are centres, a row belongs to the centre with which its direction agrees most, and a region with more than SHARD_ROWS rows is dealt into several
shards by the hash of the id. Every shard knows its mean c and the largest distance R from it. No row of a shard can have an inner product
with q above q.c + |q| R, by the triangle inequality; so a query first searches the shard it belongs to itself, and then only the shards whose
bound reaches ``factor`` of the way from its best bound down to its k-th best so far. Factor 1, the default, is exact.

In a shard, the largest norm M turns inner products
into a metric: vectors get one more component, sqrt(M**2 - |v|**2), and queries a 0, so the order by distance is that by inner product.
A node of the tree holds a vantage point and the median distance from it; queries go through a tree together, and
a branch is left out if the triangle inequality puts it beyond ``factor`` times the distance of the query's k-th
best so far. Factor 1 is exact, however the norms are spread; smaller ones leave out more, and far too much where one
norm is much larger than the rest, since then M makes up most of every distance. Leaves compare inner products themselves, and a bound gives way by
what rounding may do to a distance of that size. Equal vectors are one point of the tree with a list of ids, so a
vector that a third of the rows share neither unbalances a tree nor fills a result.

What a shard finds is scored anew in double precision on the original vectors, the same way for every row, before ranks are given.
Queries of a shard are dealt into blocks, so a task holds one shard and one block, however many there are.

Defined cases: vectors that are null, have no or only zero components, or hold a null or non-finite one take no part, nor do
rows with a null id. Vectors of different lengths don't meet. Rows that repeat an id are one row's repetitions: none is a candidate for
its own id, and for others an id with several vectors counts by its nearest. With fewer than k candidates, all are returned. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

SHARD_ROWS = 1 << 12
QUERY_ROWS = 1 << 14
#: Centres of regions, and components of all of them (32 MB), which every executor holds.
CENTRES, CENTRE_SIZE = 4096, 1 << 22
LEAF = 192
#: Queries that go through a tree together.
TOGETHER = 512
FACTOR = 1.0
#: Rounding of a distance that is a root of a difference, as a share of the largest term.
ROUNDING = 1e-7
#: More points than asked for that a shard scores anew, for what rounding may have put in another order.
SPARE = 8
OUT = "query_id long, vec_id long, score double"


class Tree:
    """Vantage-point tree over distinct vectors."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = (x**2).sum(axis=1)
        self.most = norms.max()
        self.plain = x
        self.x = np.column_stack([x, np.sqrt(np.maximum(0, self.most - norms))])
        self.leaf = leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return idx
        far = ((self.x[idx] - self.x[idx[0]]) ** 2).sum(axis=1)
        v = idx[far.argmax()]  # vantage points at the rim part best
        d = np.sqrt(((self.x[idx] - self.x[v]) ** 2).sum(axis=1))
        half = len(idx) // 2
        order = np.argpartition(d, half)
        inner, outer = idx[order[:half]], idx[order[half:]]
        return v, d[order[:half]].max(), d[order[half:]].min(), self._build(inner), self._build(outer)

    def search(self, q: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> np.ndarray:
        """Places of the k nearest of each query, -1 where there are fewer; known: scores below which nothing is wanted."""
        qq = (q**2).sum(axis=1)
        slack = ROUNDING * np.sqrt(qq + self.most)
        best, at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        if known is not None:
            best[:] = (known - ROUNDING * (np.abs(known) + np.sqrt(qq * self.most)))[:, None]

        def distance(who: np.ndarray, score: np.ndarray) -> np.ndarray:
            """What an inner product is as a distance."""
            return np.sqrt(np.maximum(0, qq[who] + self.most - 2 * score))

        def visit(node, who: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                score = q[who] @ self.plain[node].T
                both, ids = np.concatenate([best[who], score], axis=1), np.concatenate([at[who], np.broadcast_to(node, score.shape)], axis=1)
                order = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best[who], at[who] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)
                return
            v, rim, start, inner, outer = node
            d = distance(who, q[who] @ self.plain[v])
            close = d <= (rim + start) / 2
            for near, group in ((True, close), (False, ~close)):
                part, dist = who[group], d[group]
                if len(part):
                    visit(inner if near else outer, part)
                    reach = factor * distance(part, best[part].min(axis=1)) + slack[part]
                    other = dist + reach >= start if near else dist - reach <= rim
                    if other.any():
                        visit(outer if near else inner, part[other])

        visit(self.root, np.arange(len(q)))
        return at


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> pd.DataFrame:
    """The k best rows of one shard for each query, exactly scored; rows below a known score may be left out."""
    order = np.lexsort((ids,))
    ids, x = ids[order], x[order]
    _, first, group = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    # Ids of each point, smallest first, and no more than can be asked for.
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
    points = x[first]
    tree, wanted = Tree(points), min(len(points), k + 1 + SPARE)
    out = []
    for low in range(0, len(q), TOGETHER):
        found = tree.search(q[low : low + TOGETHER], wanted, factor, None if known is None else known[low : low + TOGETHER])
        for query, vector, at in zip(query_ids[low : low + TOGETHER].tolist(), q[low : low + TOGETHER], found):
            at = at[at >= 0]
            scores = (points[at] * vector).sum(axis=1)
            members = [ids[by_group[starts[p] : starts[p + 1]]] for p in at]
            members = [m[m != query][:k] for m in members]
            vec = np.concatenate([*members, ids[:0]])
            score = np.repeat(scores, [len(m) for m in members])
            best = np.lexsort((vec, -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": vec[best], "score": score[best]}))
    return pd.concat(out, ignore_index=True)


def _usable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for id_, v in zip(f["id"], f["v"]):
            if v is None or pd.isna(id_):
                continue
            v = np.array([np.nan if c is None else c for c in v], np.float64)
            if len(v) and np.isfinite(v).all() and v.any():
                rows.append((int(id_), len(v), v.tobytes()))
        yield pd.DataFrame(rows, columns=["id", "dim", "v"]).astype({"id": "int64", "dim": "int32"})


def _vectors(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(), _vectors(rows["v"])


def _centres(rows: DataFrame, sizes: dict[int, int], shard_rows: int) -> dict[int, np.ndarray]:
    """By length of vectors: directions of a sample, as many as there are shards, drawn by hash."""
    out = {}
    for dim, n in sizes.items():
        wanted = max(1, min(CENTRES, CENTRE_SIZE // dim, -(-n // shard_rows)))
        sample = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 31)) <= (1 << 31) * min(1.0, 2 * wanted / n)))
        sample = sample.dropDuplicates(["v"]).orderBy(F.xxhash64("v"), "id").limit(wanted)
        x = [r["v"] for r in sample.collect()] or [rows.where(F.col("dim") == dim).first()["v"]]
        x = _vectors(x)
        out[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


_SHARD = "dim int, region int, part int"


def _place(sent):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.copy()
            f["region"] = np.int32(0)
            for dim, group in f.groupby("dim"):
                f.loc[group.index, "region"] = (_vectors(group["v"]) @ sent.value[dim].T).argmax(axis=1).astype(np.int32)
            yield f

    return task


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is a query. is_query: a condition on column id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = common.cut(rows.mapInPandas(_usable, "id long, dim int, v binary"))
    found, _ = _search(rows, is_query, k, factor, shard_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, is_query: Column, k: int, factor: float, shard_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """query_id, vec_id, score of what may be among the k nearest; and the visits, one for each query and shard."""
    spark = rows.sparkSession
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    if not sizes:
        return rows.sparkSession.createDataFrame([], OUT), None
    placed = common.cut(rows.mapInPandas(_place(spark.sparkContext.broadcast(_centres(rows, sizes, shard_rows))), "id long, dim int, v binary, region int"))
    regions = F.broadcast(placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")))
    placed = placed.join(regions, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    balls = _balls(placed)
    sent = spark.sparkContext.broadcast(balls)
    queries = placed.where(is_query).select(F.col("id").alias("qid"), F.col("dim").alias("qdim"), F.col("v").alias("qv"), F.col("region").alias("home"), F.col("part").alias("home_part"))

    def visits(first: bool):
        """Shards of each query: its own; or all others that may hold something better than its k-th best so far."""

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = [pd.DataFrame({"id": [], "dim": [], "region": [], "part": [], "v": [], "known": []})]
                for dim, group in f.groupby("qdim"):
                    regions, parts, centre, radius = sent.value[dim]
                    q = _vectors(group["qv"])
                    score, length = q @ centre.T, np.linalg.norm(q, axis=1)[:, None]
                    bound = score + length * radius + ROUNDING * length * (radius + np.linalg.norm(centre, axis=1))
                    place = {x: n for n, x in enumerate(zip(regions.tolist(), parts.tolist()))}
                    own = np.array([place[x] for x in zip(group["home"].tolist(), group["home_part"].tolist())])
                    if first:
                        i, j, known = np.arange(len(q)), own, np.full(len(q), -np.inf)
                    else:
                        known = group["known"].to_numpy(np.float64)
                        floor = np.where(np.isfinite(known), known + (1 - factor) * np.maximum(0, bound.max(axis=1) - known), -np.inf)
                        i, j = np.nonzero((bound >= floor[:, None]) & (np.arange(bound.shape[1]) != own[:, None]))
                        known = known[i]
                    out.append(pd.DataFrame({"id": group["qid"].to_numpy()[i], "dim": dim, "region": regions[j], "part": parts[j], "v": group["qv"].to_numpy()[i], "known": known}))
                yield pd.concat(out).astype({"id": "int64", "dim": "int32", "region": "int32", "part": "int32"})

        return task

    def search(asked: DataFrame) -> DataFrame:
        keys = ["dim", "region", "part", "block"]
        blocks = F.broadcast(asked.groupBy(*keys[:3]).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")))
        asked = asked.join(blocks, keys[:3]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        base = placed.join(blocks, keys[:3]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked, base = asked.toDF(*asked.columns), base.toDF(*base.columns)

        def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
            return search_shard(*_matrix(left), *_matrix(right), k, factor, right["known"].to_numpy(np.float64))

        return base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(task, OUT)

    schema = f"id long, {_SHARD}, v binary, known double"
    home = common.cut(queries.mapInPandas(visits(True), schema))
    start = common.cut(search(home))
    kth = start.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = kth.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
    more = queries.join(kth, F.col("qid") == F.col("query_id"), "left").withColumn("known", F.coalesce("known", F.lit(float("-inf")))).drop("query_id")
    more = common.cut(more.mapInPandas(visits(False), schema))
    return start.union(search(more)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), home.union(more)


def _balls(placed: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: regions, parts, means and radii of the shards, of which there are about as many as shards' worth of rows."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each shard that the task has rows of: their number and sum."""
        sums: dict[tuple[int, int, int], list] = {}
        for f in frames:
            for key, group in f.groupby(["dim", "region", "part"]):
                t = sums.setdefault(key, [0, 0.0])
                t[0], t[1] = t[0] + len(group), t[1] + _vectors(group["v"]).sum(axis=0)
        yield pd.DataFrame([(*key, n, total.tobytes()) for key, (n, total) in sums.items()], columns=["dim", "region", "part", "n", "total"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [rows[c].iat[0]] for c in ("dim", "region", "part")} | {"mean": [(_vectors(rows["total"]).sum(axis=0) / rows["n"].sum()).tobytes()]})

    slim = placed.select("dim", "region", "part", "v")
    found = slim.mapInPandas(add, f"{_SHARD}, n long, total binary").groupBy("dim", "region", "part").applyInPandas(mean, f"{_SHARD}, mean binary").collect()
    means = placed.sparkSession.sparkContext.broadcast({(r["dim"], r["region"], r["part"]): np.frombuffer(r["mean"], np.float64) for r in found})

    def far(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most: dict[tuple[int, int, int], float] = {}
        for f in frames:
            for key, group in f.groupby(["dim", "region", "part"]):
                d = np.sqrt(((_vectors(group["v"]) - means.value[key]) ** 2).sum(axis=1)).max()
                most[key] = max(most.get(key, 0.0), float(d))
        yield pd.DataFrame([(*key, d) for key, d in most.items()], columns=["dim", "region", "part", "radius"])

    radii = slim.mapInPandas(far, f"{_SHARD}, radius double").groupBy("dim", "region", "part").agg(F.max("radius").alias("radius")).collect()
    out = {}
    for dim in {r["dim"] for r in radii}:
        own = sorted((r["region"], r["part"], r["radius"]) for r in radii if r["dim"] == dim)
        regions, parts, radius = (np.array(x) for x in zip(*own))
        out[dim] = regions.astype(np.int32), parts.astype(np.int32), np.stack([means.value[(dim, a, b)] for a, b, _ in own]), radius.astype(np.float64)
    return out
