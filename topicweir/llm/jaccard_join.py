"""Similarity join of documents by word shingles with parity sketches.

A document's set of shingles is cut into blocks by hash; a block's sketch is the XOR of the
hashes of its shingles, so a document's sketch is a row of parities. Every shingle that only
one of two sets holds changes one block, so two sets differ in at most as many blocks as their
symmetric difference is large, and linked sets of sizes a and b differ in at most (a + b) / 9
of them. By the pigeonhole principle two linked sets then agree on one of the first d + 1 of
their blocks in any common order of the blocks; blocks with many shingles come first, as they
are the rarest. Sets meet in bands of sizes S to 2 S, those below by a quarter included, so the
number of blocks suits both.

Equal sets are one node. In each group of nodes with an equal block all are first compared with
the least one; verified links give components. Pairs in different components that share a block
are then compared one by one, after their sizes and the Hamming distance of bit sketches, which
is a lower bound of the symmetric difference. No group is ever expanded into all its pairs where
it is already known to hang together, and no link between different components is lost.
"""

from pyspark.sql import DataFrame, functions as F

from topicweir.llm.common import WordHashes, sequence_hashes, tidy, worker_state
from topicweir.runtime import Scratch

SHINGLE = 5
PER_BLOCK = 1.5  # shingles in a block for the least set of a band, and 1 up to SMALL
SMALL = 64
SKETCH_WORDS = 8  # 512 bits
TILE = 1024

# Two sets link when 100 * intersection >= 80 * union. Then |A| + |B| >= 9 * symmetric difference.
SHARE = 80


def _linked(both, a, b, share):
    return 100 * both >= share * (a + b - both)


def shingles_of(text: str, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of the whole sequence."""
    import numpy as np

    # A-Z to a-z; bytes.split() cuts at the six ASCII white-space characters.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = worker_state("word-hashes", WordHashes).of(words)
    return np.unique(sequence_hashes(hashes, min(size, len(words))))


def block_keys(shingles, share: int = SHARE):
    """Keys of the blocks by which a set of shingles meets its possible partners."""
    import numpy as np

    n = len(shingles)
    keys = []
    band = n.bit_length() - 1
    for level in (band, band + 1):
        low = 1 << level
        if n * 100 < share * low:
            continue
        most = min(n * 100 // share, 2 * low - 1)  # size of the largest partner in this band
        apart = (n + most) * (100 - share) // (100 + share)
        if apart < 1:
            continue  # only equal sets link
        blocks = low if low <= SMALL else int(low / PER_BLOCK)  # the same for all sets of a band
        block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # sorted, as the hashes are
        used, first, count = np.unique(block, return_index=True, return_counts=True)
        mixed = shingles * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        parity = np.bitwise_xor.reduceat(mixed, first)
        key = (parity ^ (used + np.uint64(level << 40))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        # Empty blocks come last; if the order reaches them, an equal full block may be missing, so
        # one key then stands for the empty rest.
        order = np.lexsort((key, -count))
        keys.append(key[order[: apart + 1]])
        if apart + 1 > len(used):
            keys.append(np.array([(level << 40) + blocks + 1], dtype=np.uint64))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)


def bit_sketch(shingles):
    """Parity of the shingles in each of 512 bits, as bytes."""
    import numpy as np

    bits = SKETCH_WORDS * 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    sizes = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64)))


def _sketch(size: int, share: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, counts, high, low = [], [], [], []
            for text in (t.as_py() for t in batch.column("text")):
                own = shingles_of(text or "", size)
                keys.append(block_keys(own, share) if len(own) else own)
                counts.append(len(own))
                digest = xxhash.xxh3_128_digest(own.tobytes())
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(keys)],
                names=["doc_id", "n_shingles", "set_high", "set_low", "keys"],
            )

    return tidy("word-hashes", run)


def _groups(batches):
    """Rows sorted by key and node -> the rows of keys with two or more nodes, with the least node."""
    import numpy as np
    import pyarrow as pa

    key, center, open_row = None, None, False
    for batch in batches:
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        if not len(keys):
            continue
        new = np.r_[keys[0] != key, keys[1:] != keys[:-1]] if key is not None else np.r_[True, keys[1:] != keys[:-1]]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        centers = np.where(group < 0, center if center is not None else 0, nodes[heads][group] if len(heads) else 0)
        out_k, out_n, out_c = [], [], []
        if open_row and not new[0]:  # the last row of the batch before begins a group that goes on
            out_k.append([key]), out_n.append([center]), out_c.append([center])
        follows = ~new
        first = np.zeros(len(keys), dtype=bool)
        first[:-1] = new[:-1] & ~new[1:]
        take = follows | first
        out_k.append(keys[take]), out_n.append(nodes[take]), out_c.append(centers[take])
        open_row = bool(new[-1])
        key, center = keys[-1], centers[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).astype(np.int64)) for x in (out_k, out_n, out_c)], names=["key", "node", "center"]
        )


def _sets(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingles_of(t, size) for t in (t.as_py() for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), _lists(sets), pa.array(map(bit_sketch, sets), pa.binary())],
                names=["node", "shingles", "sketch"],
            )

    return tidy("word-hashes", run)


def _verify(share: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(len(batch)):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(_linked(both, len(a), len(b), share))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    return tidy("word-hashes", run)


def _across(share: int):
    """Rows sorted by key -> pairs of different components whose sizes and bit sketches allow a link."""

    def pairs(comp, node, size, bits):
        import numpy as np

        for i in range(0, len(node), TILE):
            for j in range(i, len(node), TILE):
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                total = size[a, None] + size[None, b]
                small = np.minimum(size[a, None], size[None, b])
                good = (comp[a, None] != comp[None, b]) & (100 * small >= share * (total - small))
                if i == j:
                    good = np.triu(good, 1)
                x, y = np.nonzero(good)
                apart = np.bitwise_count(bits[a][x] ^ bits[b][y]).sum(axis=1, dtype=np.int64)
                ok = apart * (100 + share) <= (100 - share) * total[x, y]
                yield node[a][x[ok]], node[b][y[ok]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(parts):
            comp, node, size, bits = (np.concatenate(p) for p in zip(*parts))
            for x, y in pairs(comp, node, size, bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
                )

        key, held = None, []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(keys), -1)
            columns = [batch.column(c).to_numpy() for c in ("comp", "node", "size")] + [sketches]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(keys)]):
                if held and keys[begin] != key:
                    yield from done(held)
                    held = []
                key = keys[begin]
                held.append([c[begin:end] for c in columns])
        if held:
            yield from done(held)

    return tidy("word-hashes", run)


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, comp): the least node reachable by `links` (a, b), for every node that has a link.

    Star contraction: each node is linked to the least of its neighbours instead of to all of
    them, alternately over its larger and its smaller neighbours, until nothing changes. Each
    round is written to the shared folder and the one before is removed.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        turn += 1
        edges = scratch.table(small.filter("u > v").distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def link_documents(docs: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of `docs`.

    `docs` needs `doc_id` (a whole number) and `text`; other columns are ignored. Null and empty
    texts have no shingles and link with nothing. Rows with the same id are one document with the
    links of all of them. A row without id has no component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketches = scratch.table(
        rows.mapInArrow(
            _sketch(size, share), f"doc_id {kind}, n_shingles long, set_high long, set_low long, keys array<long>"
        ),
        "sketches",
    )
    a_set = ["n_shingles", "set_high", "set_low"]
    nodes = (
        sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*a_set).agg(F.min("doc_id").cast("long").alias("node"))
    )
    nodes = scratch.table(nodes, "nodes")

    # The rows of the least document of each set, one per key.
    keyed = (
        sketches.join(nodes.select(F.col("node").alias("doc_id"), *a_set), ["doc_id", *a_set])
        .select(F.col("doc_id").cast("long").alias("node"), F.explode("keys").alias("key"))
    )
    groups = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy("word-hashes", _groups), "key long, node long, center long")
    groups = scratch.table(groups, "groups")
    grouped = scratch.table(groups.select("node").distinct(), "grouped")
    sets = (
        rows.filter(F.col("text").isNotNull())
        .withColumn("node", F.col("doc_id").cast("long"))
        .join(grouped, "node", "left_semi")
        .select("node", "text")
        .mapInArrow(_sets(size), "node long, shingles array<long>, sketch binary")
    )
    sets = scratch.table(sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right").mapInArrow(_verify(share), "a long, b long")

    star = groups.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    # Texts of one id hang together without any likeness.
    known = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *a_set)
    owned = known.join(nodes, a_set).select("doc_id", "node")
    spread = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most")
    same = owned.join(spread.select("doc_id", "a"), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
    links = scratch.table(verified(star).unionByName(same), "links")
    first = components(scratch, links, "first")

    # Groups that are not yet one component.
    placed = groups.select("key", "node").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.table(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("key")
    mixed = scratch.table(mixed, "mixed")
    light = sets.select("node", F.size("shingles").cast("long").alias("size"), "sketch")
    cross = (
        placed.join(mixed, "key")
        .join(light, "node")
        .repartition("key")
        .sortWithinPartitions("key", "comp", "node")
        .mapInArrow(_across(share), "a long, b long")
        .distinct()
    )
    more = scratch.table(verified(cross), "more")
    final = components(scratch, links.unionByName(more), "final")
    named = (
        nodes.join(final, "node", "left")
        .select(*a_set, F.coalesce("comp", "node").alias("component_id"))
    )
    slim = sketches.select("doc_id", *a_set).join(named, a_set, "left")
    # A row with an empty text belongs to the other rows of its id.
    least = slim.groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", F.col("doc_id").cast("long")))
    return slim.join(least, "doc_id", "left").select("doc_id", "n_shingles", component.alias("component_id"))
