"""Packing of token sequences by cutting-stock column generation.

Documents are tokenised once. Whole multiples of the sequence length are sequences of their
own; what is left of each document is a piece of 1 to `limit - 1` tokens. The histogram of
piece lengths, in classes of `limit / UNITS` tokens, is a cutting-stock problem: a linear
program over patterns, whose columns are priced by a knapsack dynamic program. Rounded-down
patterns take the pieces of each class by rank. Every FILLER-th piece stays out of the
patterns and is cut freely into the room that is left in the sequences. Where these pieces
cannot fill the room, the emptiest sequences are given up, as many as there are more than all
tokens fill, and their pieces are cut into the room as well; their ids are made a second time.
So no padding remains; what is left of the cut pieces forms full sequences and, at the very
end, sequences of a power of two.

Only the histogram (at most UNITS rows) and the patterns (about as many) are on the driver.
"""

import re
import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from topicweir.llm.common import Recent, load_tokenizer, text_rows, tidy, worker_state
from topicweir.runtime import Scratch, literal_array

LIMIT = 4096
UNITS = 256
FILLER = 16
CACHE_ENTRIES = 200_000

_PIECES = (
    "doc_id {kind}, part int, doc_tokens long, start long, length long, ids_crc32 long, "
    "class int, place long, tail binary, tail_end long, text_hash long"
)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _word_ids(path: str, end_id: int):
    """text -> little-endian unsigned 32-bit ids, by a cache from chunks between blanks to ids.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks in turn. A chunk of Latin letters, with or without one full stop or comma behind it,
    is one word for the tokenizer, in lower case; such words go straight to its merge model.
    A chunk that is a word but for capitals or its mark takes the ids of that word from the same cache,
    which only saves time.
    """
    return worker_state(f"packing:ids:{path}:{end_id}", lambda: _build_word_ids(path, end_id))


def _build_word_ids(path: str, end_id: int):
    tokenizer = load_tokenizer(path, "packing")
    merge = tokenizer.model.tokenize
    is_word = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
    letters = _byte_letters()

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encoded(chunk: str) -> bytes:
        return packed(tokenizer.encode(chunk, add_special_tokens=False).ids)

    end = packed([end_id])
    marks = {m: encoded(m) for m in ",."} | {"": b""}

    def chunk_ids(chunk: str) -> bytes:
        mark = chunk[-1:] if chunk[-1:] in marks else ""
        word = chunk[: len(chunk) - len(mark)].lower()
        if not is_word(word):
            return encoded(chunk)
        if word != chunk:
            return chunks[word] + marks[mark]
        return packed([t.id for t in merge(word if word.isascii() else "".join(map(letters.__getitem__, word.encode())))])

    chunks = Recent(chunk_ids, CACHE_ENTRIES)

    def ids_of(text: str) -> bytes:
        return b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" "))) + end

    return ids_of


def _cut(path: str, end_id: int, limit: int, units: int, filler: int, id_type):
    """Arrow batches of documents -> their full sequences (class -1), pieces (class 1 to
    `units`) and filler pieces (class 0), each with its place among those of its task."""

    def run(batches):
        import zlib

        import pyarrow as pa

        ids_of = _word_ids(path, end_id)
        part = TaskContext.get().partitionId()
        places = [0] * (units + 2)
        width = limit // units
        seen = 0
        filled = 0
        names = ["doc_tokens", "start", "length", "ids_crc32", "class", "place", "tail", "tail_end"]
        for batch in batches:
            out = {n: [] for n in names}
            source = []
            for row, text in enumerate(t.as_py() for t in batch.column("text")):
                ids = ids_of(text)
                total = len(ids) // 4
                for start in range(0, total, limit):
                    piece = ids[4 * start : 4 * (start + limit)]
                    length = len(piece) // 4
                    kind, tail, tail_end = -1, None, None
                    if length < limit:
                        kind = -(-length // width)
                        if seen % filler == 0:
                            kind, tail = 0, piece
                            filled += length
                            tail_end = filled
                        seen += 1
                    source.append(row)
                    values = (total, start, length, zlib.crc32(piece), kind, places[kind], tail, tail_end)
                    for n, v in zip(names, values):
                        out[n].append(v)
                    places[kind] += 1
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(source, pa.int64())),
                    pa.array([part] * len(source), pa.int32()),
                    *[pa.array(out[n], t) for n, t in zip(names, types)],
                    batch.column("text_hash").take(pa.array(source, pa.int64())),
                ],
                names=["doc_id", "part", *names, "text_hash"],
            )

    return tidy("packing", run)


def _last_pieces(path: str, end_id: int, limit: int):
    """Arrow batches of documents -> the ids behind their last full sequence."""

    def run(batches):
        import pyarrow as pa

        ids_of = _word_ids(path, end_id)
        for batch in batches:
            tails = []
            for text in (t.as_py() for t in batch.column("text")):
                ids = ids_of(text)
                tails.append(ids[len(ids) // (4 * limit) * 4 * limit :])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(tails, pa.binary())],
                names=["_id", "_of", "tail"],
            )

    return tidy("packing", run)


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over class widths 1..n with capacity n: the value and the counts."""
    n = len(prices)
    value = np.zeros(n + 1)
    choice = np.zeros(n + 1, dtype=np.int64)
    for room in range(1, n + 1):
        offers = value[room - 1 :: -1] + prices[:room]  # class c leaves room - c
        pick = int(np.argmax(offers))
        if offers[pick] > value[room - 1] + 1e-12:
            value[room], choice[room] = offers[pick], pick + 1
        else:
            value[room] = value[room - 1]
    counts = np.zeros(n, dtype=np.int64)
    room = n
    while room > 0:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[n]), counts


def cutting_stock(demand: np.ndarray, rounds: int = 20_000) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is cut, covering `demand[c]` pieces of width c + 1 exactly.

    Delayed column generation by the revised simplex method: the basis starts with one pattern
    per class, duals price the knapsack, and the best new pattern enters until none improves by
    more than 1e-7. The basic solution is rounded down; the rest, less than one pattern per
    class, is cut greedily from the widest class down. `rounds` is a guard against cycling;
    any basis gives a valid packing.
    """
    n = len(demand)
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    columns = np.zeros((n, len(classes)), dtype=np.int64)
    for j, c in enumerate(classes):
        columns[c, j] = n // (c + 1)
    inverse = np.diag(1.0 / columns[classes, np.arange(len(classes))])
    amounts = inverse @ demand[classes]
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(n)
        prices[classes] = np.maximum(duals, 0)
        value, pattern = best_pattern(prices)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern[classes]
        rising = step > 1e-9
        if not rising.any():
            break
        ratios = np.where(rising, amounts / np.where(rising, step, 1), np.inf)
        out = int(np.argmin(ratios))
        amounts = amounts - ratios[out] * step
        amounts[out] = ratios[out]
        inverse[out] /= step[out]
        others = np.arange(len(classes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        columns[:, out] = pattern
    cuts = []
    rest = demand.astype(np.int64).copy()
    for j in np.argsort(-amounts, kind="stable"):
        used = columns[:, j]
        times = int(min(np.floor(amounts[j] + 1e-9), (rest[used > 0] // used[used > 0]).min()))
        if times > 0:
            cuts.append((times, used.copy()))
            rest -= times * used
    while rest.any():
        room, pattern = n, np.zeros(n, dtype=np.int64)
        for c in np.flatnonzero(rest)[::-1]:
            take = min(int(rest[c]), room // (c + 1))
            pattern[c], room = take, room - take * (c + 1)
        used = pattern > 0
        times = int((rest[used] // pattern[used]).min())
        cuts.append((times, pattern))
        rest -= times * pattern
    return cuts


def fullest(cuts: list[tuple[int, np.ndarray]], sequences: int) -> list[tuple[int, np.ndarray]]:
    """The patterns of the `sequences` fullest sequences; what the others hold is to be cut."""
    fill = [int((p * np.arange(1, len(p) + 1)).sum()) for _, p in cuts]
    kept = []
    for j in np.argsort([-f for f in fill], kind="stable"):
        times = min(cuts[j][0], sequences)
        if times > 0:
            kept.append((times, cuts[j][1]))
            sequences -= times
    return kept


def _slots(cuts: list[tuple[int, np.ndarray]], units: int) -> list[list[tuple[int, int, int, int]]]:
    """Per class: (first rank, pieces per sequence, first sequence, place in it) of each pattern."""
    slots = [[] for _ in range(units + 1)]
    ranks = [0] * (units + 1)
    base = 0
    for times, pattern in cuts:
        place = 0
        for c in np.flatnonzero(pattern):
            count = int(pattern[c])
            slots[c + 1].append((ranks[c + 1], count, base, place))
            ranks[c + 1] += times * count
            place += count
        base += times
    return slots


def _assign(slots):
    """Pieces with their rank in their class -> sequence and place in it."""

    def run(frames):
        import pandas as pd

        for f in frames:
            sequence = np.zeros(len(f), dtype=np.int64)
            place = np.zeros(len(f), dtype=np.int64)
            kinds, ranks = f["class"].to_numpy(), f["rank"].to_numpy()
            for c in np.unique(kinds):
                own = np.array(slots[c], dtype=np.int64)
                at = np.flatnonzero(kinds == c)
                first, count, base, offset = own[np.searchsorted(own[:, 0], ranks[at], side="right") - 1].T
                past = ranks[at] - first
                sequence[at] = base + past // count
                place[at] = offset + past % count
            yield pd.concat(
                [
                    f[["doc_id", "doc_tokens", "start", "length", "ids_crc32"]],
                    pd.DataFrame({"sequence_id": sequence, "slot": place}, index=f.index),
                ],
                axis=1,
            )

    return tidy("packing", run)


def _running(df: DataFrame, value: str, *order: str, block: str) -> DataFrame:
    """`before`: the sum of `value` over all earlier rows, by sums per block and within blocks."""
    sums = df.groupBy(block).agg(F.sum(value).alias("_sum"))
    # One row per block of 65,536 sequences or per task: a table of job size.
    ahead = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(block, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, block).withColumn(
        "before", F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    ).drop("_ahead")


def _crc_slices(batches):
    import zlib

    import pyarrow as pa

    for b in batches:
        crcs = [
            zlib.crc32(t[4 * s : 4 * (s + n)])
            for t, s, n in zip(b.column("tail").to_pylist(), b.column("skip").to_pylist(), b.column("length").to_pylist())
        ]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(n) for n in names], pa.array(crcs, pa.int64())], names=[*names, "ids_crc32"]
        )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    limit: int = LIMIT,
    units: int = UNITS,
    filler: int = FILLER,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    `docs` needs `doc_id` and `text`; other columns are ignored. A null or empty text is its end
    id alone. Each input row is packed by itself, also when rows or ids repeat. An empty table
    gives no pieces. `docs` is read a second time if sequences are given up. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(
        rows.mapInArrow(
            _cut(tokenizer_path, end_id, limit, units, filler, kind), _PIECES.format(kind=kind.simpleString())
        ),
        "pieces",
    )

    # Ranks over all tasks: how many of each class the earlier tasks hold. One row per task and class.
    counts = pieces.groupBy("part", "class").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))
    counts = scratch.table(counts, "counts")
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part",
        "class",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
    )
    totals = {r["class"]: (r.n, r.tokens) for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    demand = np.array([totals.get(c, (0, 0))[0] for c in range(1, units + 1)], dtype=np.int64)
    # More sequences than all tokens fill would hold padding, whichever pieces are cut.
    wanted = cutting_stock(demand)
    n_pattern = min(sum(times for times, _ in wanted), sum(t for c, (_, t) in totals.items() if c >= 0) // limit)
    cuts = fullest(wanted, n_pattern)
    in_patterns = sum((times * pattern for times, pattern in cuts), np.zeros(units, dtype=np.int64))
    n_full = totals.get(-1, (0, 0))[0]
    filler_tokens = totals.get(0, (0, 0))[1]

    ranked = pieces.drop("tail").join(offsets, ["part", "class"]).withColumn("rank", F.col("place") + F.col("n_before"))
    in_pattern = F.col("rank") < F.get(literal_array([0, *in_patterns.tolist()], "bigint"), F.col("class"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = ranked.filter("class = -1").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("rank") + n_pattern).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    assigned = (
        ranked.filter((F.col("class") > 0) & in_pattern)
        .select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "class", "rank")
        .mapInPandas(
            _assign(_slots(cuts, units)),
            f"doc_id {kind.simpleString()}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, slot long",
        )
    )
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot")
    placed = scratch.table(
        assigned.withColumn("end", F.sum("length").over(in_sequence)).withColumn("offset", F.col("end") - F.col("length")),
        "placed",
    )

    # Pieces of the sequences given up go behind the filler.
    freed = None
    if (in_patterns < demand).any():
        freed = _running(ranked.filter((F.col("class") > 0) & ~in_pattern), "length", "class", "place", block="part").select(
            "doc_id", "doc_tokens", "text_hash", F.col("start").alias("piece_start"), F.col("length").alias("size"),
            (F.col("before") + filler_tokens).cast("long").alias("from"),
        )
        freed = scratch.table(freed, "freed")
        filler_tokens += freed.agg(F.sum("size")).first()[0]
        keys = freed.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_of"))
        tails = (
            rows.join(keys, same, "left_semi")
            .dropDuplicates(["doc_id", "text_hash"])
            .mapInArrow(_last_pieces(tokenizer_path, end_id, limit), f"_id {kind.simpleString()}, _of long, tail binary")
        )
        freed = freed.join(tails, same)

    # The room left in the pattern sequences, then sequences made of filler alone.
    room = placed.groupBy("sequence_id").agg((limit - F.max("end")).alias("room")).filter("room > 0")
    room = scratch.table(room, "room")
    left = max(0, filler_tokens - (room.agg(F.sum("room")).first()[0] or 0))
    total_room = filler_tokens - left
    room = _running(
        room.withColumn("block", F.col("sequence_id").bitwiseAND(~65535)), "room", "sequence_id", block="block"
    ).select("sequence_id", F.col("room").cast("long").alias("room"), F.col("before").cast("long").alias("at"))
    first = n_pattern + n_full
    whole = spark.range(left // limit).select(
        (F.col("id") + first).alias("sequence_id"),
        F.lit(limit).cast("long").alias("room"),
        (F.col("id") * limit + total_room).alias("at"),
    )
    powers, at = [], total_room + left // limit * limit
    for bit in range(limit.bit_length() - 1, -1, -1):
        if (left % limit) >> bit & 1:
            powers.append((first + left // limit + len(powers), 1 << bit, at))
            at += 1 << bit
    gaps = room.withColumn("filled", limit - F.col("room")).unionByName(
        whole.unionByName(spark.createDataFrame(powers, "sequence_id long, room long, at long")).withColumn("filled", F.lit(0).cast("long"))
    )
    fillers = (
        pieces.filter("class = 0")
        .join(offsets, ["part", "class"])
        .select(
            "doc_id", "doc_tokens", F.col("start").alias("piece_start"), F.col("length").alias("size"), "tail",
            (F.col("tail_end") - F.col("length") + F.col("tokens_before")).cast("long").alias("from"),
        )
    )
    if freed is not None:
        fillers = fillers.unionByName(freed.select(*fillers.columns))

    def by_block(df: DataFrame, begin: str, size: str) -> DataFrame:
        ends = (F.col(begin) + F.col(size) - 1) / limit
        return df.withColumn("block", F.explode(F.sequence((F.col(begin) / limit).cast("long"), ends.cast("long"))))

    low = F.greatest("from", "at")
    cut = (
        by_block(fillers, "from", "size")
        .join(by_block(gaps, "at", "room"), "block")
        .withColumn("low", low)
        .withColumn("length", F.least(F.col("from") + F.col("size"), F.col("at") + F.col("room")) - F.col("low"))
        .filter((F.col("length") > 0) & ((F.col("low") / limit).cast("long") == F.col("block")))
        .select(
            "doc_id", (F.col("piece_start") + F.col("low") - F.col("from")).alias("start"), "length", "doc_tokens",
            "sequence_id", (F.col("filled") + F.col("low") - F.col("at")).alias("offset"),
            "tail", (F.col("low") - F.col("from")).alias("skip"),
        )
        .mapInArrow(
            _crc_slices,
            f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long",
        )
    )
    return full.select(*out).unionByName(placed.select(*out)).unionByName(cut.select(*out))
