"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into geometric buckets, which are cut into blocks of bounded size.
A first look at some of the longest vectors gives each query a score that k vectors reach; a
block is visited only if the query's length times the block's greatest length reaches it. Inside
a block the same bound is a local cosine threshold. Where it is high, candidates must lie in a
narrow range of the query's largest coordinates (coordinate pruning); where it is low, only
candidates that are long enough are taken (length pruning). The products of what is left are
computed in whole numbers; queries that leave much of a block take it in one matrix product.

A tile of some blocks meets a group of queries in one place: a block travels once per group of
`GROUP` queries and a query once per tile, and a task holds one tile and one group. What the
tile's blocks gave raises the bound for its next ones.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from topicweir.runtime import Scratch

K = 5
PER_OCTAVE = 8  # buckets per doubling of the length
BLOCK = 4096
QUERY_BLOCK = 512
SEEDS = 2048
COORDINATES = 3
HIGH_COSINE = 0.3
GROUP = 16_384  # queries that meet a tile at one time
TILES = 256  # so many tiles at most, until they hold `MOST_BLOCKS`
LEAST_BLOCKS, MOST_BLOCKS = 4, 64  # in a tile
AT_ONCE = 512  # queries in one matrix product


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null if the vector is null or any component is null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return F.when(embedding.isNotNull() & ~F.exists(embedding, lambda x: F.coalesce(odd(x.cast("double")), F.lit(True))), whole)


def _matrix(vectors) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to one width; doubles where all products are exact in them."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(1, width)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _cross(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All products of the rows of two matrices of whole numbers, in the narrowest type that is exact for them.

    No partial sum exceeds the product of the lengths.
    """
    width = min(one.shape[1], many.shape[1])
    one, many = one[:, :width], many[:, :width]
    length = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) for x in (one, many)]
    top = length[0] * length[1] * (1 + 1e-6)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return one.astype(kind) @ many.astype(kind).T


def candidates_for(query: np.ndarray, least: float, block: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions in a block (sorted by falling length) whose product with `query` can reach `least`."""
    length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
    if least <= 0 or length == 0:
        return np.arange(len(block)) if least <= 0 else np.zeros(0, dtype=np.int64)
    enough = int(np.searchsorted(-lengths, -(least / length) * (1 - 1e-12), side="right"))
    if enough == 0:
        return np.zeros(0, dtype=np.int64)
    cosine = min(1.0, least / (length * lengths[0]) * (1 - 1e-9))
    if cosine < HIGH_COSINE:
        return np.arange(enough)
    keep = np.ones(enough, dtype=bool)
    for f in np.argsort(-np.abs(query))[:COORDINATES]:
        if f >= block.shape[1]:
            continue
        q = query[f] / length
        room = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q * q)))
        low = q * cosine - room if q * cosine - room > -1 and cosine > -q else -1.0
        high = q * cosine + room if cosine > q else 1.0
        share = block[:enough, f] / lengths[:enough]
        keep &= (share >= low - 1e-9) & (share <= high + 1e-9)
    return np.flatnonzero(keep)


def _stored(matrix: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all."""
    top = int(np.abs(matrix).max(initial=0))
    return matrix.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8").tobytes()


def _loaded(stored: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(stored, f"<i{max(1, len(stored) // (rows * width))}").reshape(rows, width).astype(np.int64)


def _pack(frame):
    import pandas as pd

    frame = frame.sort_values(["length", "vec_id"], ascending=[False, True])
    matrix = _matrix(frame["v"].tolist())
    return pd.DataFrame(
        {
            "block": [int(frame["block"].iloc[0])],
            "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
            "lengths": [frame["length"].to_numpy(np.float64).tobytes()],
            "matrix": [_stored(matrix)],
            "width": [matrix.shape[1]],
            "longest": [float(frame["length"].max())],
        }
    )


def _pack_queries(k: int, seed_ids: bytes, seed_vectors: list):
    def run(frame):
        import pandas as pd

        seeds, ids = _matrix(seed_vectors), np.frombuffer(seed_ids, dtype=np.int64)
        matrix, own = _matrix(frame["v"].tolist()), frame["query_id"].to_numpy(np.int64)
        least = np.full(len(frame), -np.inf)
        if len(ids) >= k:
            scores = _cross(matrix, seeds).astype(np.float64)
            scores[own[:, None] == ids] = -np.inf
            least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        return pd.DataFrame(
            {
                "part": [int(frame["part"].iloc[0])],
                "queries": [frame["query"].to_numpy(np.int64).tobytes()],
                "query_ids": [own.tobytes()],
                "q_matrix": [_stored(matrix)],
                "q_width": [matrix.shape[1]],
                "least": [least.tobytes()],
                "q_longest": [float(frame["length"].max())],
                "q_least": [float(least.min())],
            }
        )

    return run


class Found:
    """The k best of some queries so far, as rows (query, score, id), and the score that the next must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.query, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query, score, ids) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        kept = place < self.k
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]


def _look_through(found: Found, matrix, lengths_of, own, block, lengths, ids) -> None:
    """Take what a block (sorted by falling length) has for each query."""
    order = np.argsort(ids, kind="stable")
    ends = [np.searchsorted(ids[order], own, side) for side in ("left", "right")]
    asked = np.flatnonzero((found.least <= 0) | (lengths_of * lengths[0] * (1 + 1e-9) >= found.least))
    whole = []
    for q in asked:
        least = found.least[q]
        if least <= 0 or least / max(lengths_of[q] * lengths[0], 1e-300) < HIGH_COSINE:
            whole.append(q)
            continue
        at = candidates_for(matrix[q], float(least), block, lengths)
        if len(at) * 4 > len(block):
            whole.append(q)
            continue
        at = at[ids[at] != own[q]]
        scores = _cross(matrix[q : q + 1], block[at])[0].astype(np.int64)
        good = scores >= least
        if good.any():
            found.add(np.full(good.sum(), q), scores[good], ids[at][good])
    for begin in range(0, len(whole), AT_ONCE):
        some = np.array(whole[begin : begin + AT_ONCE])
        least = found.least[some]
        # The shortest query bound decides how many are long enough for any of them.
        reach = np.where(least > 0, least / np.maximum(lengths_of[some], 1e-300), -np.inf).min()
        enough = int(np.searchsorted(-lengths, -reach * (1 - 1e-12), side="right")) if reach > 0 else len(block)
        scores = _cross(matrix[some], block[:enough])
        out = np.zeros(scores.shape, bool)
        for i in np.flatnonzero(ends[1][some] > ends[0][some]):
            mine = order[ends[0][some[i]] : ends[1][some[i]]]
            out[i, mine[mine < enough]] = True
        good = (scores >= least[:, None]) & ~out
        many = np.flatnonzero(good.sum(axis=1) > 8 * found.k)
        for i in many:
            of = np.sort(scores[i][good[i]])
            good[i] &= scores[i] >= of[-found.k]
        row, at = np.nonzero(good)
        found.add(some[row], scores[row, at].astype(np.int64), ids[at])


def _search(k: int):
    """A tile's blocks and a group's parts of queries -> the k best of each query in the tile."""

    def run(blocks, asked):
        import pyarrow as pa

        out = [(np.zeros(0, np.int64),) * 4]
        blocks = [
            (_loaded(r["matrix"], len(r["ids"]) // 8, r["width"]), np.frombuffer(r["lengths"]), np.frombuffer(r["ids"], np.int64))
            for r in sorted(blocks.to_pylist(), key=lambda r: -r["longest"])
        ]
        for r in asked.to_pylist():
            queries, own = np.frombuffer(r["queries"], np.int64), np.frombuffer(r["query_ids"], np.int64)
            matrix = _loaded(r["q_matrix"], len(queries), r["q_width"])
            lengths_of = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
            found = Found(np.frombuffer(r["least"]), k)
            for block, lengths, ids in blocks:
                _look_through(found, matrix, lengths_of, own, block, lengths, ids)
            out.append((queries[found.query], own[found.query], found.ids, found.score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, seeds: int = SEEDS
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other vectors for each query.

    `vectors` needs `vec_id` (a whole number) and `embedding`; other columns are ignored. `is_query`
    is a condition on vec_id. Vectors that are null, or hold null or non-finite components, and rows
    without id take no part; shorter vectors count as padded with zeros. Rows alike in id and vector
    count once; different vectors of one id are queries and candidates of their own. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Of equal vectors only the k + 1 smallest ids can be among the k best of any query.
    equal = Window.partitionBy("v").orderBy("vec_id")
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
        .filter("vec_id IS NOT NULL AND v IS NOT NULL")
        .distinct()
        .withColumn("length", length)
    )
    rows = scratch.table(rows, "rows")
    cands = (
        rows.withColumn("n", F.row_number().over(equal))
        .filter(F.col("n") <= k + 1)
        .withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log2("length") * PER_OCTAVE)).otherwise(-99999).cast("int"))
        .drop("n")
    )
    cands = scratch.table(cands, "candidates")
    # One row per bucket of lengths: a few hundred at most.
    sizes = sorted(((r.bucket, r.n) for r in cands.groupBy("bucket").agg(F.count("*").alias("n")).collect()), reverse=True)
    queries = scratch.table(
        rows.filter(is_query).select(
            F.col("vec_id").alias("query_id"), F.monotonically_increasing_id().alias("query"), "v", "length"
        ),
        "queries",
    )
    n_queries = queries.count()
    schema = "query long, query_id long, vec_id long, score long"
    if not sizes or not n_queries:
        found = spark.createDataFrame([], schema)
    else:
        first, base = {}, 0
        for bucket, n in sizes:
            first[bucket] = (base, -(-n // block))
            base += -(-n // block)
        start = F.create_map(*[F.lit(x) for b, (f, _) in first.items() for x in (b, f)])
        parts = F.create_map(*[F.lit(x) for b, (_, p) in first.items() for x in (b, p)])
        packed = (
            cands.withColumn("block", start[F.col("bucket")] + F.pmod(F.xxhash64("vec_id"), parts[F.col("bucket")]).cast("int"))
            .groupBy("block")
            .applyInPandas(_pack, "block int, ids binary, lengths binary, matrix binary, width int, longest double")
        )
        size = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-base // TILES)))
        packed = scratch.table(packed.withColumn("tile", F.floor(F.col("block") / size).cast("int")), "packed")
        seen = cands.filter(F.col("bucket") >= _bucket_of(sizes, seeds)).select("vec_id", "v").limit(seeds).collect()
        seed_ids = np.array([r.vec_id for r in seen], dtype=np.int64).tobytes()
        asked = (
            queries.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(-(-n_queries // query_block))).cast("int"))
            .groupBy("part")
            .applyInPandas(
                _pack_queries(k, seed_ids, [r.v for r in seen]),
                "part int, queries binary, query_ids binary, q_matrix binary, q_width int, least binary, q_longest double, q_least double",
            )
        )
        per_group = max(1, GROUP // query_block)
        asked = scratch.table(asked.withColumn("group", F.floor(F.col("part") / per_group).cast("int")), "asked")
        groups = -(-(-(-n_queries // query_block)) // per_group)
        # Which tiles a part of the queries visits; the bound is checked again for each query and block.
        tiles = packed.groupBy(F.col("tile").alias("t_tile")).agg(F.max("longest").alias("t_longest"))
        reached = (F.col("q_least") <= 0) | (F.col("q_longest") * F.col("t_longest") * (1 + 1e-9) >= F.col("q_least"))
        bounds = asked.select("part", "q_longest", "q_least").crossJoin(F.broadcast(tiles)).filter(reached)
        visits = asked.join(bounds.select("part", F.col("t_tile").alias("tile")), "part")
        copies = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        keys = ["tile", "group"]
        found = copies.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_search(k), schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _bucket_of(sizes: list[tuple[int, int]], seeds: int) -> int:
    """The bucket down to which the longest vectors number at least `seeds`."""
    seen = 0
    for bucket, n in sizes:
        seen += n
        if seen >= seeds:
            return bucket
    return sizes[-1][0]
