"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid. A query probes the lists with the greatest q.c + REACH |q| r, c
being the list's centre and r the farthest of all its vectors from c (with REACH = 1 a bound on every inner product in
the list), so that lists of long vectors are read wherever they lie.

A query reads its most promising lists whole; the k-th best score there is its mark. In the other probed lists the
rotated vectors are read in blocks of columns. A pair's squared distance D is known to exceed R, the one that its mark
allows, when the part read so far is too large: after a random rotation the share of D in m of n columns follows a
Beta(m/2, (n-m)/2) distribution, so that a pair with D <= R passes the 1 - ERROR quantile of it, times R, with chance
ERROR only. Such pairs are abandoned; marks rise as better scores are found. Survivors are scored in double precision
on the original vectors. The rotation makes all columns alike, so that they need no order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import guarded_broadcast, materialize

NEIGHBOURS = 20
QUERY_STEP = 20
#: Vectors that the centroids are fitted on, at most, and their bytes; sampled vectors to a list at least.
SAMPLE, SAMPLE_BYTES, PER_LIST = 20_000, 64 << 20, 20
#: Lists: so many times the square root of the number of vectors.
LISTS_PER_ROOT, LEAST_LISTS = 0.5, 4
#: Share of the lists that a query probes, and the least number; share of those that it reads whole, for its mark.
PROBED, LEAST_PROBED, WHOLE = 0.85, 10, 0.15
#: Share of a list's radius that counts when lists are chosen.
REACH = 0.2
#: Vectors of a shelf (neighbouring lists, or a part of one) at most, shelves that a table has (if they aren't smaller
#: than the least), and queries that meet a shelf in one task.
SHELF, SHELVES, LEAST_SHELF, QUERIES = 1 << 16, 48, 1 << 10, 1 << 13
#: Columns read between two tests, and the chance that one test abandons a pair within its mark.
COLUMNS, ERROR = 16, 0.1
#: Pairs of queries and candidates that are tested at a time.
PAIRS = 1 << 20

HITS = "ask bigint, query_id bigint, vec_id bigint, score double"


def usable(embedding: Column) -> Column:
    """Neither null nor empty, with no null or non-finite component, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


@cache
def rotation(width: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, made once in each process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def centroids(points: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means; a list that loses all its points keeps its centre."""
    found = points[np.random.default_rng(seed).choice(len(points), min(lists, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(points, found, 1)[:, 0]
        counts = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest_lists(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each point, in no order."""
    gap = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return np.argpartition(gap, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(points), 1))


def promising_lists(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, n: int) -> np.ndarray:
    """The n lists of each query that promise the greatest inner products, in no order."""
    promise = queries @ centres.T + REACH * np.linalg.norm(queries, axis=1)[:, None] * radii[None, :]
    return np.argpartition(-promise, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(len(centres)), (len(queries), 1))


@cache
def share_quantile(read: int, width: int, error: float = ERROR) -> float:
    """The 1 - error quantile of the share of a squared length that lies in `read` of `width` columns after a random rotation."""
    if read >= width:
        return 1.0
    x = np.linspace(0, 1, 20_001)[1:-1]
    density = np.exp((read / 2 - 1) * np.log(x) + ((width - read) / 2 - 1) * np.log1p(-x))
    upto = np.cumsum(density)
    return float(x[np.searchsorted(upto, (1 - error) * upto[-1])])


def _best(who: np.ndarray, what: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best hits of each query, nearest first, ties to the smaller id."""
    order = np.lexsort((ids[what], -scores, who))
    who, what, scores = who[order], what[order], scores[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[kept], what[kept], scores[kept]


def scan(queries: np.ndarray, mark: np.ndarray, read: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, error: float = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query among those that it may read: query, candidate, score, and the pairs alive after each test.

    `read` says which pairs are probed; `own` and `rows` are row numbers, by which a query leaves its own row out. A
    query whose mark is -inf reads its candidates whole. The last of `alive` counts the pairs scored, the first all.
    """
    dims = vectors.shape[1]
    turn = rotation(dims)
    turned_queries, turned = queries @ turn, vectors @ turn
    norms, own_norms = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
    tests = [*range(COLUMNS, dims, COLUMNS), dims]
    alive_after = np.zeros(len(tests) + 1, np.int64)
    mark, out = mark.copy(), []
    size = max(1, PAIRS // max(1, len(queries)))
    for first in range(0, len(ids), size):
        part = slice(first, first + size)
        alive = read[:, part] & (own[:, None] != rows[None, part])
        alive_after[0] += alive.sum()
        reach = own_norms[:, None] + norms[None, part] - 2 * mark[:, None]
        begin = slice(0, tests[0])
        a, b = turned_queries[:, begin], turned[part, begin]
        gap = np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)
        alive &= gap <= reach * share_quantile(tests[0], dims, error) + 1e-9
        who, what = np.nonzero(alive)
        partial, limit, what = gap[alive], reach[alive], what + first
        alive_after[1] += len(who)
        for k_test, (at, upto) in enumerate(zip(tests, tests[1:]), 2):
            partial = partial + ((turned[what, at:upto] - turned_queries[who, at:upto]) ** 2).sum(axis=1)
            kept = partial <= limit * share_quantile(upto, dims, error) + 1e-9
            who, what, partial, limit = who[kept], what[kept], partial[kept], limit[kept]
            alive_after[k_test] += len(who)
        found = who, what, (vectors[what] * queries[who]).sum(axis=1)
        held = [np.concatenate([x, y]) for x, y in zip(out, found)] if out else found
        out = _best(*held, ids, k)
        # The k-th best so far is a mark as well: nothing below it can be among the k.
        count = np.bincount(out[0], minlength=len(queries))
        full = np.flatnonzero(count >= k)
        last = np.searchsorted(out[0], full) + k - 1
        mark[full] = np.maximum(mark[full], out[2][last] - 1e-9)
    return (*(out or (np.zeros(0, int), np.zeros(0, int), np.zeros(0))), alive_after)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def fit_lists(rows: DataFrame, count: int, dims: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the lists, from a hashed sample of at most `sample` vectors (fewer where they'd be beyond SAMPLE_BYTES)."""
    bound = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    draw, full = F.xxhash64("vec_id", "embedding"), 1 << 30
    share = min(full, 2 * full * bound // max(1, count))
    drawn = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(full)) < share).orderBy("draw").limit(bound).select("embedding").toPandas()
    points = _matrix(drawn["embedding"]) if len(drawn) else np.eye(dims)[:1]
    return centroids(points, int(max(1, min(len(points) // PER_LIST, max(LEAST_LISTS, LISTS_PER_ROOT * math.sqrt(count))))))


def shelved(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each list and the number of parts of each shelf: neighbouring lists share one, a long list is cut into parts."""
    total = sum(sizes.values())
    room = min(SHELF, max(LEAST_SHELF, total // SHELVES))
    shelf, parts, held = np.zeros(lists, np.int32), [0], 0
    for k in range(lists):
        n = sizes.get(k, 0)
        if held and held + n > room:
            parts.append(0)
            held = 0
        held += n
        shelf[k], parts[-1] = len(parts) - 1, max(1, -(-held // room))
    return shelf, np.array(parts, np.int32)


def search(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, probed: float = PROBED, sample: int = SAMPLE, error: float = ERROR) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for every query (vec_id divisible by `step`).

    The candidates of a query are all other rows; score is the inner product in double precision. Vectors that are
    null, empty, zero or hold a null or non-finite component take no part, nor do those without an id or of another
    width than the commonest. Repeated rows are candidates of their own, also for each other, but ask once; rows of
    one id with different vectors ask each for themselves, with ranks of their own. An empty table gives an empty
    result; other columns are ignored.
    The centroids are fitted on at most `sample` vectors; every vector is dealt to a list, and lists of any size meet
    the queries in shelves of bounded size. A query's vector is sent once to each shelf that it probes.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    widths = rows.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, count = widths[0]["w"], widths[0]["n"]
    rows = rows.where(F.size("embedding") == dims)
    centres = fit_lists(rows, count, dims, sample)
    lists = len(centres)
    held = spark.sparkContext.broadcast(centres)  # SAMPLE_BYTES / PER_LIST at most

    def filing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own, centres = _matrix(batch["embedding"]), held.value
                home = nearest_lists(own, centres, 1)[:, 0]
                yield pd.DataFrame({"vec_id": batch["vec_id"], "embedding": batch["embedding"], "list": home.astype(np.int32), "off": np.linalg.norm(own - centres[home], axis=1)})

    filed = materialize(rows.mapInPandas(filing, "vec_id bigint, embedding array<double>, list int, off double"))
    filed = materialize(filed.withColumn("row", F.monotonically_increasing_id()))
    about = filed.groupBy("list").agg(F.max("off").alias("radius"), F.count("*").alias("n")).collect()  # a row per list
    radii = np.zeros(lists)
    for r in about:
        radii[r["list"]] = r["radius"]
    shelf, parts = shelved({r["list"]: r["n"] for r in about}, lists)
    probes = min(lists, max(LEAST_PROBED, math.ceil(probed * lists)))
    whole = max(1, math.ceil(WHOLE * probes))
    layout = spark.sparkContext.broadcast((centres, radii, shelf))

    def ordered_lists(queries: np.ndarray) -> np.ndarray:
        """The probed lists of each query, the most promising first."""
        centres, radii, _ = layout.value
        promise = queries @ centres.T + REACH * np.linalg.norm(queries, axis=1)[:, None] * radii[None, :]
        return np.argsort(-promise, axis=1, kind="stable")[:, :probes]

    known = F.broadcast(spark.createDataFrame([(k, int(shelf[k]), int(parts[shelf[k]])) for k in range(lists)], "list int, shelf int, parts int"))  # a row per list
    asks = filed.where(F.col("vec_id") % step == 0).groupBy("vec_id", "embedding").agg(F.min("row").alias("row"))
    asks = materialize(asks.select("row", "vec_id", "embedding", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-(count // step + 1) // QUERIES)))).cast("int").alias("block")))
    stock = filed.join(known, "list").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))

    def meet(first: bool, marks: DataFrame) -> DataFrame:
        """Hits of all queries in the lists that they read whole (first) or in the other probed ones."""

        def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    order = ordered_lists(_matrix(batch["embedding"]))
                    order = order[:, :whole] if first else order[:, whole:]
                    yield batch.assign(shelves=[np.unique(layout.value[2][x]).astype(np.int32) for x in order])

        sent = marks.mapInPandas(called, "row bigint, vec_id bigint, embedding array<double>, block int, mark double, shelves array<int>")
        sent = sent.select("row", "vec_id", "embedding", "block", "mark", F.explode("shelves").alias("shelf"))
        cells = materialize(sent.groupBy("shelf", "block").agg(F.count("*").alias("n")))  # a row per shelf and block of queries
        spans = known.select("shelf", "parts").distinct()
        sent = sent.join(F.broadcast(spans), "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        theirs = sent.select("shelf", "part", "block", F.lit(True).alias("asks"), "row", "vec_id", "embedding", "mark", F.lit(0).alias("list"))
        mine = stock.join(guarded_broadcast(cells.select("shelf", "block")), "shelf").select("shelf", "part", "block", F.lit(False).alias("asks"), "row", "vec_id", "embedding", F.lit(0.0).alias("mark"), "list")

        def scanned(group: pd.DataFrame) -> pd.DataFrame:
            mine, asks = group[~group["asks"]].sort_values(["vec_id", "row"]), group[group["asks"]]
            if not len(mine) or not len(asks):
                return pd.DataFrame({c.split()[0]: [] for c in HITS.split(", ")}).astype({"score": "float64"})
            queries, home = _matrix(asks["embedding"]), mine["list"].to_numpy()
            stock, ids, rows = _matrix(mine["embedding"]), mine["vec_id"].to_numpy(), mine["row"].to_numpy()
            order = ordered_lists(queries)
            probing = np.zeros((len(queries), lists), bool)
            np.put_along_axis(probing, order[:, :whole] if first else order[:, whole:], True, axis=1)
            asked, names, mark, out = asks["row"].to_numpy(), asks["vec_id"].to_numpy(), asks["mark"].to_numpy(), []
            for at in range(0, len(queries), 256):
                own = slice(at, at + 256)
                who, what, score, _ = scan(queries[own], mark[own], probing[own][:, home], asked[own], rows, ids, stock, k, error)
                out.append(pd.DataFrame({"ask": asked[own][who], "query_id": names[own][who], "vec_id": ids[what], "score": score}))
            return pd.concat(out)

        return mine.unionByName(theirs).groupBy("shelf", "part", "block").applyInPandas(scanned, HITS)

    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = materialize(best(meet(True, asks.withColumn("mark", F.lit(float("-inf"))))))
    marks = near.groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score") - 1e-9).otherwise(F.lit(float("-inf"))).alias("mark"))
    marked = asks.join(marks, asks["row"] == marks["ask"], "left").select("row", "vec_id", "embedding", "block", F.coalesce("mark", F.lit(float("-inf"))).alias("mark"))
    far = meet(False, marked) if probes > whole else near.drop("rank").limit(0)
    columns = [c.split()[0] for c in HITS.split(", ")]
    return best(near.select(*columns).unionByName(far)).select("query_id", "rank", "vec_id", "score")
