"""Near copies of documents by fast similarity sketches, banding and exact verification.

A sketch has T coordinates. In each round every shingle of a set is hashed to one coordinate with
a value that belongs to the round, and a coordinate keeps its least value; from round T on, round
T + k puts all shingles into coordinate k. So after 2 T rounds no coordinate is empty, though most
sets need only a few, and two sets agree in a coordinate with a probability equal to their
similarity, all coordinates together close to it with the concentration of independent ones.
Bands of five coordinates make the keys: 51 bands miss a pair of similarity 0.8 once in 6e8.

Equal sets are one node. Each node is first compared with the least one of all that share a key with
it: by sketch, then exactly; links give components. Nodes of keys that then still hold several
components are compared with further centers, other ones in each round. Keys that are left are dealt into
tiles of bounded size; pairs of tiles are spread over tasks, where pairs of different components
are compared by size and sketch, each pair in the first key that both share. Nodes with a partner
there meet once more in the same pair of tiles, now with their full sets, and of the pairs that
link only those come out that join two components. So no row is made for a pair that is merely
alike, however many there are, and no full set for each key of a node.
"""

from pyspark.sql import DataFrame, functions as F

from topicweir.llm.common import text_rows
from topicweir.llm.jaccard_join import components, shingles_of
from topicweir.runtime import Scratch

SHINGLE = 2
SHARE = 80  # sets link when 100 * intersection >= 80 * union
COORDINATES = 256
BAND = 5
# At a similarity of 0.8 the agreeing coordinates have mean 205 and deviation 6.4; 170 is 5.4 below.
AGREEING = 170
ROUNDS = 3  # of further centers
CENTERS = 2  # that a node is compared with in a round; what they leave is compared in tiles
TILE = 2048
HEAVY = 1 << 20  # shingles of a tile, unless one set alone has more
PAIRS = 1 << 20  # compared at a time in a pair of tiles
SLICE = 1 << 20  # shingles sketched at a time


def sketch(shingles, owner, n_sets: int, size: int = COORDINATES):
    """Sketches (n_sets x size, unsigned) of sets given as flat arrays of shingles and set numbers."""
    import numpy as np

    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_sets, size), none, np.uint64)
    flat = out.reshape(-1)
    turn, look = 0, 1
    while len(shingles) and turn < 2 * size:
        h = shingles + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        place = (h & np.uint64(size - 1)).astype(np.int64) if turn < size else turn - size
        value = np.uint64(turn << 54) | (h >> np.uint64(10))
        np.minimum.at(flat, owner * size + place, value)
        turn += 1
        if turn == look:  # later rounds change no full sketch, so looking seldom is enough
            look += max(1, turn // 4)
            full = (out != none).all(axis=1)
            keep = ~full[owner]
            shingles, owner = shingles[keep], owner[keep]
    return out


def band_keys(sketches, band: int = BAND):
    """A 64-bit key for each run of `band` coordinates, and one byte of every coordinate."""
    import numpy as np

    sets, size = sketches.shape
    bands = size // band
    mixed = np.repeat(np.arange(bands, dtype=np.uint64)[None], sets, axis=0)
    for i in range(band):
        mixed ^= sketches[:, i : bands * band : band]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    value = sketches * np.uint64(0xD6E8FEB86659FD93)
    return mixed, (value >> np.uint64(56)).astype(np.uint8)


def _slices(batch, size: int):
    """The batch's texts as (first row, list of sets), about `SLICE` shingles at a time."""
    held, total, first = [], 0, 0
    for at, text in enumerate(batch.column("text")):
        held.append(shingles_of(text.as_py(), size))
        total += len(held[-1])
        if total >= SLICE or len(held) == 2048:
            yield first, held
            held, total, first = [], 0, at + 1
    if held:
        yield first, held


def _sketched(sets):
    import numpy as np

    sizes = np.array(list(map(len, sets)))
    return band_keys(sketch(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))


def _keyed(size: int):
    """(doc_id, text) -> size and digest of the set, its band keys and its sketch of bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for first, sets in _slices(batch, size):
                keys, small = _sketched(sets)
                counts = np.array(list(map(len, sets)))
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                offsets = np.r_[0, np.cumsum(np.where(counts > 0, keys.shape[1], 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array(counts, pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].reshape(-1).view(np.int64))),
                        pa.array(map(np.ndarray.tobytes, small), pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_high", "set_low", "keys", "sketch"],
                )

    return run


def _sets(size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, sets in _slices(batch, size):
                offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["node", "shingles"],
                )

    return run


def _verify(share: int):
    """Pairs with both full sets -> those that link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(len(batch)):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= share * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _bytes_matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _alike(share: int):
    """Pairs with both sizes and sketches -> those that may link."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            good = 100 * np.minimum(m, n) >= share * np.maximum(m, n)
            if len(batch):
                good &= (_bytes_matrix(batch.column("left")) == _bytes_matrix(batch.column("right"))).sum(axis=1) >= AGREEING
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _units(batches):
    """The rows of one pair of tiles at a time, as an Arrow table."""
    import numpy as np
    import pyarrow as pa

    current, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        unit = np.column_stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
        cuts = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(unit)]):
            if held and (unit[begin] != current).any():
                yield pa.Table.from_batches(held)
                held = []
            current = unit[begin].copy()
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _partners(unit, share: int):
    """Pairs of rows, the first ones in order, that are of different components and may link by size and sketch.

    Where rows have all their keys, a pair is taken in the first key that both share, and in no other.
    """
    import numpy as np

    tile, comp, size = (unit.column(c).to_numpy() for c in ("tile", "comp", "size"))
    bits = _bytes_matrix(unit.column("sketch"))
    keys = unit.column("keys").combine_chunks().flatten().to_numpy().reshape(len(unit), -1) if "keys" in unit.column_names else None
    key, low, high = (unit.column(c)[0].as_py() for c in ("key", "low", "high"))
    own, other = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    found = [(own[:0], own[:0])]
    step = max(1, PAIRS // max(1, len(other)))
    for begin in range(0, len(own), step):
        part = own[begin : begin + step]
        good = comp[part][:, None] != comp[other][None]
        m, n = size[part][:, None], size[other][None]
        good &= 100 * np.minimum(m, n) >= share * np.maximum(m, n)
        if low == high:
            good &= part[:, None] < other[None]
        x, y = np.nonzero(good)
        x, y = part[x], other[y]
        for at in range(0, len(x), 4096):
            i, j = x[at : at + 4096], y[at : at + 4096]
            alike = (bits[i] == bits[j]).sum(axis=1) >= AGREEING
            i, j = i[alike], j[alike]
            if keys is not None:
                first = (keys[i] == keys[j]).argmax(axis=1)
                here = keys[i, first] == key
                i, j = i[here], j[here]
            found.append((i, j))
    return tuple(map(np.concatenate, zip(*found)))


def _with_partner(share: int):
    """Rows of tile pairs, in order -> those that may link with another of their tile pair."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches):
            met = np.zeros(len(unit), bool)
            for rows in _partners(unit, share):
                met[rows] = True
            yield from unit.filter(pa.array(met)).to_batches()

    return run


def _joining(share: int):
    """Rows of tile pairs with full sets, in order -> pairs that link, as many as join the components."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for unit in _units(batches):
            x, y = _partners(unit, share)
            node, group, size = unit.column("node").to_numpy(), unit.column("comp").to_numpy().copy(), unit.column("size").to_numpy()
            known, ranks = np.unique(unit.column("shingles").combine_chunks().flatten().to_numpy(), return_inverse=True)
            sets = np.split(ranks, np.cumsum(size)[:-1])
            inside = np.zeros(len(known), np.int32)
            found = []
            firsts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else []
            for begin, end in zip(firsts, [*firsts[1:], len(x)]):
                one, others = x[begin], y[begin:end]
                others = others[group[others] != group[one]]
                if not len(others):
                    continue
                inside[sets[one]] = 1
                both = np.add.reduceat(inside[np.concatenate([sets[i] for i in others])], np.r_[0, np.cumsum(size[others])[:-1]])
                inside[sets[one]] = 0
                others = others[100 * both >= share * (size[one] + size[others] - both)]
                groups, at = np.unique(group[others], return_index=True)
                found += [(min(node[one], node[i]), max(node[one], node[i])) for i in others[at]]
                group[np.isin(group, groups)] = group[one]
            if found:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.array(found, np.int64).T)), names=["a", "b"])

    return run


def near_copies(docs: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    `docs` needs `doc_id` (a whole number) and `text`; other columns are ignored. Null and empty
    texts have no shingles and link with nothing. Rows with the same id are one document with the
    links of all their texts; each row has the number of shingles of its own text. A row without
    id has no component, and its `kept` is null. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-copies")
    rows = text_rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    a_set = ["n_shingles", "set_high", "set_low"]
    keyed = rows.mapInArrow(_keyed(size), f"doc_id {kind}, n_shingles long, set_high long, set_low long, keys array<long>, sketch binary")
    keyed = scratch.table(keyed, "keyed")
    # A node is a distinct set, named by the least document that has it; equal sets have equal keys.
    known = keyed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    node_rows = known.groupBy(*a_set).agg(
        F.min("doc_id").cast("long").alias("node"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")
    )
    node_rows = scratch.table(node_rows, "node-rows")
    nodes = node_rows.select(*a_set, "node")

    entries = node_rows.select("node", F.explode("keys").alias("key"))
    centers = entries.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).filter("members > 1")
    met = scratch.table(entries.join(centers.drop("members"), "key"), "met")
    light = node_rows.select("node", F.col("n_shingles").alias("size"), "sketch")

    # Full sets of all nodes that meet another; a row repeated many times is one text first.
    grouped = met.select("node").distinct()
    texts = rows.filter("text <> ''").select(F.col("doc_id").cast("long").alias("node"), "text", F.xxhash64("text").alias("digest"))
    texts = texts.groupBy("node", "digest").agg(F.any_value("text").alias("text")).join(grouped, "node", "left_semi").select("node", "text")
    sets = scratch.table(texts.mapInArrow(_sets(size), "node long, shingles array<long>").filter("size(shingles) > 0"), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        found = pairs.join(two, "b").join(one, "a").select("a", "b", "left", "right").mapInArrow(_verify(share), "a long, b long")
        return scratch.table(found, name)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs of nodes those that link, judged by sketch and then by the full sets."""
        first = light.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("left"))
        second = light.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("right"))
        seen = pairs.distinct().join(second, "b").join(first, "a").select("a", "b", "m", "n", "left", "right")
        seen = scratch.table(seen.mapInArrow(_alike(share), "a long, b long"), f"{name}-alike")
        return verified(seen, name)

    def mixed(comps: DataFrame, name: str) -> DataFrame:
        """Rows of the keys that hold several components."""
        placed = met.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        placed = scratch.table(placed, name)
        several = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
        return placed.join(several.select("key"), "key")

    # Texts of one id hang together without any likeness.
    owned = known.select("doc_id", *a_set).join(nodes, a_set).select("doc_id", "node")
    spread = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).filter("a < most")
    same = owned.join(spread.select("doc_id", "a"), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
    star = met.groupBy("node").agg(F.min("center").alias("a")).filter("a < node").select("a", F.col("node").alias("b"))
    star = linked(star, "star")
    comps = components(scratch, scratch.table(star.unionByName(same), "links"), "comps-0")
    for turn in range(1, ROUNDS + 1):
        live = mixed(comps, f"placed-{turn}")
        # One order for all keys of a round: keys of one family mostly have the same center. A node
        # has at most as many centers as bands, of which it takes the first ones in that order.
        order = F.xxhash64("node", F.lit(turn))
        center = live.groupBy("key").agg(F.min(F.struct(order.alias("place"), "node", "comp")).alias("center"))
        pairs = live.join(center, "key").filter(F.col("comp") != F.col("center.comp"))
        near = F.slice(F.sort_array(F.collect_set(F.struct("center.place", "center.node"))), 1, CENTERS)
        pairs = pairs.groupBy("node").agg(near.alias("near")).select("node", F.explode("near.node").alias("other"))
        more = linked(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), f"links-{turn}")
        comps = components(scratch, comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more), f"comps-{turn}")
        scratch.drop(f"placed-{turn}")

    dealt = mixed(comps, "placed").join(node_rows.select("node", F.col("n_shingles").alias("size"), "sketch", "keys"), "node")
    dealt = scratch.table(dealt, "dealt")
    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / HEAVY)).cast("int")
    dealt = dealt.join(dealt.groupBy("key").agg(tiles.alias("tiles")), "key")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    unit = ["key", "low", "high"]
    columns = [*unit, "tile", "comp", "node", "size", "sketch", "keys"]
    kinds = "key long, low int, high int, tile int, comp long, node long, size long, sketch binary, keys array<long>"
    near = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .select(*columns)
        .repartition(*unit)
        .sortWithinPartitions(*unit)
        .mapInArrow(_with_partner(share), kinds)
    )
    cross = (
        near.join(sets, "node")
        .filter(F.size("shingles") == F.col("size"))  # an id may stand for several sets
        .select(*columns, "shingles")
        .repartition(*unit)
        .sortWithinPartitions(*unit)
        .mapInArrow(_joining(share), "a long, b long")
    )
    cross = scratch.table(cross, "links-cross")
    scratch.drop("met")
    scratch.drop("placed")
    scratch.drop("dealt")
    last = comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(cross)
    final = components(scratch, last, "final")
    scratch.drop("sets")
    named = nodes.join(final, "node", "left").select(*a_set, F.coalesce("comp", "node").alias("component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id").cast("long")).otherwise(F.col("component_id"))
    slim = keyed.select("doc_id", *a_set).join(named, a_set, "left")
    # A row with an empty text belongs to the other rows of its id.
    least = slim.groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", own))
    return (
        slim.join(least, "doc_id", "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )
