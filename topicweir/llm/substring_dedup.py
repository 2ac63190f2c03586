"""Removal of repeated passages with FM-indexes over shards of the corpus.

Every window of WINDOW words contains a least run of GRAM words by hash, its fingerprint; equal
windows have equal fingerprints. Fingerprints that stand in one document only are dropped, which
leaves the neighbourhoods of possible repeats. These are dealt into shards by fingerprint, so
that all places of a window are in one shard, and each shard of bounded size gets a compressed
FM-index of its word sequences. Backward search over its wavelet matrix finds the interval of
every window of the streamed documents, and the least document in it is the window's first
place. Fingerprints in more than HOT documents would overfill a shard; their windows are dealt
and sorted one by one instead, and read as a stream in constant memory.
"""

from pyspark.sql import DataFrame, functions as F

from topicweir.llm.common import WordHashes, sequence_hashes, worker_state
from topicweir.runtime import Scratch

WINDOW = 13
GRAM = 5
SHARD = 40_000  # neighbourhoods per shard
HOT = 20_000  # documents of one fingerprint
CODE = 5  # bytes of a word's hash inside a shard, next to the 64 bits of the fingerprint


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # at the six ASCII white-space characters


def fingerprints(words, window: int, gram: int):
    """For each window start, the fingerprint of its window (numpy, signed)."""
    import numpy as np

    grams = sequence_hashes(words, gram).view(np.int64)
    n, wide = len(words) - window + 1, window - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for i in range(1, wide):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def _flat(batch, window: int, gram: int):
    """Slices of a batch's texts: (first row, word hashes of all, row of each window, its place, fingerprint).

    Windows that reach into the next text are left out.
    """
    import numpy as np

    hashes = worker_state("word-hashes", WordHashes)

    def flat(first, parts):
        sizes = np.array(list(map(len, parts)))
        words = np.concatenate(parts)
        least = fingerprints(words, window, gram)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(len(parts)), sizes)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + window <= ends[row])
        return first, words, row[at], at, least[at]

    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column("text")):
        held.append(hashes.of(split_words(text.as_py())))
        size += len(held[-1])
        if size > 500_000:
            yield flat(first, held)
            first, held, size = i + 1, [], 0
    if held:
        yield flat(first, held)


def _prints(window: int, gram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, _, row, _, least in _flat(batch, window, gram):
                new = np.ones(len(row), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
                source = pa.array(first + row[new], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(least[new]), batch.column("doc_id").take(source)], names=["print", "doc_id"])

    return run


def _shared(batches):
    """Rows sorted by fingerprint and document -> those of fingerprints in two or more documents, numbered within each."""
    import numpy as np
    import pyarrow as pa

    held = None  # the last fingerprint: (value, its first document, documents so far, whether the first row waits)
    for batch in batches:
        prints, docs = batch.column("print").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(prints):
            continue
        # Rows alike in both stem from documents with one id.
        again = np.r_[held is not None and prints[0] == held[0] and docs[0] == held[3], (prints[1:] == prints[:-1]) & (docs[1:] == docs[:-1])]
        prints, docs = prints[~again], docs[~again]
        if not len(prints):
            continue
        goes_on = held is not None and prints[0] == held[0]
        new = np.r_[not goes_on, prints[1:] != prints[:-1]]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place = np.arange(len(prints)) - np.where(group < 0, 0, heads[group] if len(heads) else 0)
        place = np.where(group < 0, place + (held[1] if goes_on else 0), place)
        take = ~new
        take[:-1] |= new[:-1] & ~new[1:]
        out = [prints[take], docs[take], place[take]]
        if goes_on and held[2]:
            out = [np.r_[h, x] for h, x in zip((held[0], held[3], 0), out)]
        held = (prints[-1], int(place[-1]) + 1, bool(new[-1]), docs[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["print", "doc_id", "place"])


def _neighbourhoods(window: int, gram: int, shards: int):
    """Documents with their shared fingerprints -> runs of windows with one fingerprint, and single windows of hot ones."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def listed(column, first, rows):
            """Marks of the fingerprints in each row's list; a rare wrong mark only adds a neighbourhood."""
            lists = column.slice(first, rows)
            return marks(np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy())

        def marks(row, prints):
            return prints.view(np.uint64) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

        for batch in batches:
            for first, words, row, at, least in _flat(batch, window, gram):
                if not len(row):
                    continue
                rows = int(row[-1]) + 1
                own = marks(row, least)
                shared, hot = (np.isin(own, listed(batch.column(n), first, rows)) for n in ("shared", "hot"))
                raw = words.view(np.uint8).reshape(-1, 8)[:, :CODE]
                place = at - at[np.searchsorted(row, row)]  # in its text
                new = np.ones(len(row), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (shared[1:] != shared[:-1]) | (row[1:] != row[:-1])
                begins = np.flatnonzero(new)
                ends = np.r_[begins[1:], len(row)]
                begins, ends = begins[shared[begins]], ends[shared[begins]]
                codes = [raw[a : b + window - 1].tobytes() for a, b in zip(at[begins], at[ends - 1] + 1)]
                lone = np.flatnonzero(hot)
                whole = sequence_hashes(words, window).view(np.int64)[at[lone]]
                taken = pa.array(first + row[np.r_[begins, lone]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(taken), batch.column("_hash").take(taken),
                        pa.array(np.r_[least[begins] % shards, np.full(len(lone), -1)].astype(np.int32)),
                        pa.array(place[np.r_[begins, lone]].astype(np.int32)),
                        pa.array([*codes, *[None] * len(lone)], pa.binary()),
                        pa.array([*[None] * len(begins), *whole.tolist()], pa.int64()),
                    ],
                    names=["doc_id", "_hash", "shard", "start", "codes", "single"],
                )

    return run


def _indexed(window: int):
    """A shard -> the windows of its documents that also stand in an earlier document."""

    def run(frame):
        import numpy as np
        import pandas as pd

        from topicweir.llm.fm_index import FMIndex

        docs = frame["doc_id"].to_numpy(np.int64)
        kinds, kind = _distinct(frame["codes"].tolist())
        earliest = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(earliest, kind, docs)
        sizes = np.array([len(k) // CODE for k in kinds])
        padded = np.zeros((int(sizes.sum()), 8), dtype=np.uint8)
        padded[:, :CODE] = np.frombuffer(b"".join(kinds), dtype=np.uint8).reshape(-1, CODE)
        alphabet, symbols = np.unique(padded.view(np.uint64).ravel(), return_inverse=True)
        ends = np.cumsum(sizes)
        sequences = np.split(symbols.astype(np.int64) + 1, ends[:-1])
        index = FMIndex(sequences, len(alphabet))
        # All windows of the distinct sequences, one after another.
        counts = sizes - window + 1
        first = np.repeat(ends - sizes, counts)
        inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        patterns = (symbols.astype(np.int64) + 1)[(first + inside)[:, None] + np.arange(window)]
        patterns, of = _distinct_rows(patterns)
        least = np.concatenate(
            [index.least(*index.search(p), earliest) for p in np.array_split(patterns, max(1, len(patterns) // 100_000))]
        )[of]
        begin = np.cumsum(counts) - counts
        n = counts[kind]
        row = np.repeat(np.arange(len(kind)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = least[begin[kind[row]] + step] < docs[row]
        row, step = row[hit], step[hit]
        return pd.DataFrame(
            {"doc_id": docs[row], "_hash": frame["_hash"].to_numpy()[row], "start": frame["start"].to_numpy()[row] + step.astype(np.int32)}
        )

    return run


def _distinct(codes: list[bytes]):
    import numpy as np

    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(c, len(number)) for c in codes], dtype=np.int64)
    return list(number), kind


def _distinct_rows(rows):
    """The distinct rows of a matrix of whole numbers, in some order, and the place of each row among them."""
    import numpy as np

    mixed = np.zeros(len(rows), dtype=np.uint64)
    for column in rows.T:
        mixed ^= column.astype(np.uint64)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    _, first, of = np.unique(mixed, return_index=True, return_inverse=True)
    if (rows[first][of] != rows).any():  # two rows with one mix
        return rows, np.arange(len(rows))
    return rows[first], of


def _later(batches):
    """Rows sorted by window and document -> those whose document is not the window's first."""
    import numpy as np
    import pyarrow as pa

    window, first = None, None
    for batch in batches:
        singles, docs = batch.column("single").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(singles):
            continue
        new = np.r_[window is None or singles[0] != window, singles[1:] != singles[:-1]]
        group = np.cumsum(new) - 1
        heads = docs[np.flatnonzero(new)]
        firsts = np.where(group < 0, first if first is not None else 0, heads[group] if len(heads) else 0)
        window, first = singles[-1], firsts[-1]
        yield batch.select(["doc_id", "_hash", "start"]).filter(pa.array(docs > firsts))


def _report(window: int):
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            totals, removed, digests = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("_starts").to_pylist()):
                words = split_words(text)
                totals.append(len(words))
                gone = 0
                if starts:
                    drop = np.zeros(len(words), dtype=bool)
                    drop[np.unique(np.add.outer(np.array(starts), np.arange(window)))] = True
                    gone = int(drop.sum())
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(doc_id, _hash, start) of every window of `docs` (doc_id, text, _hash) that stands in a document with a smaller id."""
    known = docs.filter("doc_id IS NOT NULL")
    prints = known.select("doc_id", "text").mapInArrow(_prints(window, gram), "print long, doc_id long")
    shared = (
        prints.repartition("print").sortWithinPartitions("print", "doc_id").mapInArrow(_shared, "print long, doc_id long, place long")
    )
    shared = scratch.table(shared, "shared")
    n = shared.count()
    crowded = scratch.table(shared.filter(F.col("place") == hot).select("print", F.lit(True).alias("crowded")), "crowded")
    per_doc = (
        shared.join(crowded, "print", "left")
        .groupBy("doc_id")
        .agg(
            F.collect_list(F.when(F.col("crowded").isNull(), F.col("print"))).alias("shared"),
            F.collect_list(F.when(F.col("crowded"), F.col("print"))).alias("hot"),
        )
    )
    places = known.join(per_doc, "doc_id").select("doc_id", "text", "_hash", "shared", "hot").mapInArrow(
        _neighbourhoods(window, gram, max(1, -(-n // shard))),
        "doc_id long, _hash long, shard int, start int, codes binary, single long",
    )
    places = scratch.table(places, "places")
    schema = "doc_id long, _hash long, start int"
    found = places.filter("shard >= 0").groupBy("shard").applyInPandas(_indexed(window), schema)
    single = (
        places.filter("shard < 0")
        .select("single", "doc_id", "_hash", "start")
        .repartition("single")
        .sortWithinPartitions("single", "doc_id")
        .mapInArrow(_later, schema)
    )
    return found.unionByName(single)


def dedup_passages(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of `docs`.

    `docs` needs `doc_id` (a whole number) and `text`; other columns are ignored. Null and empty texts
    have no words. Every input row gives one row; rows with one id are places of one document and
    never repeat each other. A row without id loses and takes nothing. An empty table gives an empty
    result. Windows are judged on the input, not on what is left.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    hits = repeated_windows(keyed, scratch, **sizes)
    hits = hits.groupBy("doc_id", "_hash").agg(F.collect_set("start").alias("_starts"))
    hits = scratch.table(hits, "hits").select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), "_starts")
    scratch.drop("places")
    joined = keyed.join(hits, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_of")), "left")
    return joined.select("doc_id", "text", "_starts").mapInArrow(
        _report(sizes.get("window", WINDOW)), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
