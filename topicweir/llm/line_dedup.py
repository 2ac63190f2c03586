"""Line deduplication by winnowing over line hashes.

Lines without text are passed over. A line of n words stands for ceil(n / UNIT_WORDS) units, at
most WINDOW of them, each with a hash of the whole line and its number in it: a line that fills a
window alone (9 words or more) is deleted wherever it stands again, shorter ones in runs that fill
one. More units than WINDOW would change nothing, since every window that touches such a line
names the whole line, and so does the line's own window. Of every window of WINDOW consecutive units the least hash is selected as a
fingerprint; equal windows select equal fingerprints, so every repeated run of WINDOW units or
more is sure to share one. Fingerprints that stand at one place only are dropped; around the
others the windows are compared, which extends a match to both sides as far as it goes. A line
is deleted if a window that touches it also starts at an earlier place: in a document earlier
by (doc_id, hash of its text), or before in the same document.
"""

from pyspark.sql import DataFrame, functions as F

from topicweir.llm.common import tidy
from topicweir.runtime import Scratch

WINDOW = 3
UNIT_WORDS = 4


def line_units(text: str, window: int, unit_words: int):
    """Line numbers of the units of a text, at most `window` a line, and their 64-bit hashes (signed)."""
    import numpy as np
    import xxhash

    lines, hashes = [], []
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if line:
            units = min(window, -(-len(line.split()) // unit_words))
            base = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
            lines += [number] * units
            hashes += [base] * units
            for u in range(1, units):
                hashes[u - units] = xxhash.xxh3_64_intdigest(base.to_bytes(8, "little"), seed=u)
    return np.array(lines, dtype=np.int64), np.array(hashes, dtype=np.uint64).view(np.int64)


def _fingerprints(window: int, unit_words: int):
    """One row per fingerprint: its hash and the windows (first unit, hash) that select it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        odd = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            source, prints, starts, keys, sizes = [], [], [], [], [0]
            for row, text in enumerate(t.as_py() for t in batch.column("text")):
                _, units = line_units(text, window, unit_words)
                n = len(units) - window + 1
                if n < 1:
                    continue
                views = np.lib.stride_tricks.sliding_window_view(units, window)
                # Of equal least hashes the last one, so that neighbouring windows agree.
                place = np.arange(n) + window - 1 - np.argmin(views[:, ::-1], axis=1)
                mixed = np.zeros(n, dtype=np.uint64)
                for i in range(window):
                    mixed = (mixed ^ units[i : i + n].view(np.uint64)) * odd
                    mixed ^= mixed >> np.uint64(29)
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                source += [row] * len(first)
                prints.append(units[place[first]])
                starts.append(np.arange(n, dtype=np.int32))
                keys.append(mixed.view(np.int64))
                sizes += (sizes[-1] + np.r_[first[1:], n]).tolist()
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            at = pa.array(sizes, pa.int32())
            taken = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat(prints, np.int64)),
                    batch.column("doc_id").take(taken),
                    batch.column("_hash").take(taken),
                    pa.ListArray.from_arrays(at, pa.array(flat(starts, np.int32))),
                    pa.ListArray.from_arrays(at, pa.array(flat(keys, np.int64))),
                ],
                names=["print", "doc_id", "_hash", "starts", "keys"],
            )

    return tidy("line-dedup", run)


def _delete(window: int, unit_words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, totals, removed = [], [], []
            for text, starts in zip((t.as_py() for t in batch.column("text")), batch.column("_starts").to_pylist()):
                lines = (text or "").split("\n")
                totals.append(sum(1 for x in lines if x.strip()))
                gone = set()
                if starts:
                    numbers, _ = line_units(text, window, unit_words)
                    hit = np.add.outer(np.array(starts, dtype=np.int64), np.arange(window)).ravel()
                    gone = set(numbers[hit].tolist())
                    text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
                texts.append(text)
                removed.append(len(gone))
            new = {
                "text": pa.array(texts, pa.string()),
                "_lines": pa.array(totals, pa.int64()),
                "_removed": pa.array(removed, pa.int64()),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return tidy("line-dedup", run)


def dedup_lines(docs: DataFrame, window: int = WINDOW, unit_words: int = UNIT_WORDS) -> DataFrame:
    """`docs` with repeated runs of lines cut out of `text`, and `_lines` and `_removed` counts.

    All columns stay; `doc_id` and `text` are needed. Null and empty texts have no lines and stay
    as they are. Rows alike in id and text count as one document. The first place of a run stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = (
        keyed.filter(F.col("text").isNotNull())
        .select("doc_id", "text", "_hash")
        .mapInArrow(
            _fingerprints(window, unit_words),
            f"print long, doc_id {kind}, _hash long, starts array<int>, keys array<long>",
        )
    )
    prints = scratch.table(prints, "prints")
    repeated = prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    repeated = scratch.table(repeated, "repeated")
    places = (
        prints.join(repeated, "print")
        .select("print", "doc_id", "_hash", F.inline(F.arrays_zip("starts", "keys")))
        .select("print", F.col("keys").alias("key"), F.struct("doc_id", "_hash", F.col("starts").alias("start")).alias("place"))
    )
    places = scratch.table(places, "places")
    scratch.drop("prints")
    first = (
        places.groupBy("print", "key")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("print", "key", "first")
    )
    first = scratch.table(first, "first")
    later = places.join(first, ["print", "key"]).filter("place > first").select("place.*")
    later = later.groupBy("doc_id", "_hash").agg(F.collect_set("start").alias("_starts"))
    later = scratch.table(later, "later").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), "_starts")
    scratch.drop("places")
    joined = keyed.join(later, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    joined = joined.select(*docs.columns, "_starts", F.lit(0).cast("long").alias("_lines"), F.lit(0).cast("long").alias("_removed"))
    return joined.mapInArrow(_delete(window, unit_words), joined.schema).drop("_starts")


def line_report(deduped: DataFrame) -> DataFrame:
    return deduped.select(
        "doc_id",
        F.col("_lines").alias("n_lines"),
        F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
