"""Spelling variants: words one edit apart, met through asymmetric chunks.

A word is cut into two disjoint chunks. One inserted, deleted or replaced code point spoils at
most one of them, so the other stands unchanged in the near word, at the same place or shifted
by one. The longer word of a pair gives its chunks, the other (as long or one shorter) gives the
positional grams that lie within that shift: from its start for a left chunk, from its end for a
right one. The half that holds the edit is cut again in the same way until it has at most two
code points. A key then says all of a word but those two, so at most 90 * 90 + 90 words (the
alphabet has 90 letters) share one, however many words begin or end alike.

Within a key the words differ in the two open code points alone, which are compared one by one.
A pair counts only under the key that holds the leftmost place where its edit can be, so no pair
counts twice, and each key gives sums and best partners per word, never pairs.
"""

import functools

from pyspark.sql import DataFrame, functions as F

from topicweir.llm.common import text_rows
from topicweir.runtime import Scratch

MIN_LENGTH = 5
MIN_COUNT = 3
DOMINANCE = 2
OPEN = 2  # code points left open by a key
DAMAGE = 97
HELD_WORDS = 200_000


def intervals(length: int) -> list[tuple[int, int]]:
    """The places 0..length cut into halves until none has more than `OPEN` code points."""
    todo, done = [(0, length)], []
    while todo:
        i, j = todo.pop()
        if j - i <= OPEN:
            done.append((i, j))
        else:
            todo += [((i + j) // 2, j), (i, (i + j) // 2)]
    return done


def _damaged(owner: str, word: str, damage: int) -> str:
    import zlib

    h = zlib.crc32(f"{owner}:{word}".encode())
    if h % damage:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _count(damage: int | None):
    def run(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        runs = re.compile("[a-zÀ-ÿ]+")
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.string()).to_pylist()
            for owner, text in zip(ids, batch.column("text")):
                # Bytes are lowered from A to Z only.
                own = Counter(runs.findall(text.as_py().encode("utf-8", "replace").lower().decode()))
                if damage is None:
                    held.update(own)
                else:
                    for word, n in own.items():
                        held[_damaged(owner or "", word, damage)] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    return run


def count_words(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, n): runs of letters in all texts, A-Z lower-cased, and how often each occurs.

    With `damage`, every run for which that number divides the crc32 of `doc_id:run` loses the
    code point at that value modulo its length, which plants misspellings.
    """
    rows = text_rows(docs).filter("text <> ''")
    return rows.mapInArrow(_count(damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(batches):
    """(id, word, n) -> a row per chunk key: the open code points x and y (0 where there is none)."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    cuts = functools.lru_cache(maxsize=256)(intervals)

    def rows_of(word, length):
        """Keys of `word` as one of two words of which the longer has `length` code points."""
        for i, j in cuts(length):
            end = len(word) - (length - j)
            digest = xxhash.xxh3_128_intdigest(f"{length}.{i}.{word[:i]}\0{word[end:]}")
            rest = [*map(ord, word[i:end]), 0, 0]
            yield digest >> 64, digest & 0xFFFFFFFFFFFFFFFF, rest[0], rest[1], ord(word[i - 1]) if i else 0, len(word) == length

    def batch_of(ids, counts, rows):
        high, low, x, y, before, own = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(high, np.uint64).view(np.int64)),
                pa.array(np.array(low, np.uint64).view(np.int64)),
                pa.array(ids, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(x, pa.int32()),
                pa.array(y, pa.int32()),
                pa.array(before, pa.int32()),
                pa.array(own, pa.bool_()),
            ],
            names=["high", "low", "id", "n", "x", "y", "before", "own"],
        )

    for batch in batches:
        ids, counts, rows = [], [], []
        for id, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n"))):
            for length in (len(word), len(word) + 1):
                new = list(rows_of(word, length))
                rows += new
                ids += [id] * len(new)
                counts += [n] * len(new)
            if len(rows) > 50_000:
                yield batch_of(ids, counts, rows)
                ids, counts, rows = [], [], []
        if rows:
            yield batch_of(ids, counts, rows)


def near_sums(group, id, n, x, y, before, own):
    """Per word of whole groups: (id, near words, largest n of them, the least id with it), in parts.

    `group` numbers the keys. Words of the longer length are `own`; they have code points x and y
    open (y 0 if one is open), the shorter words one less (x, or none).
    """
    import numpy as np

    parts = []

    def segments(keys, take):
        """Order by keys, then best word first; start and length of each segment per element."""
        at = np.flatnonzero(take)
        order = at[np.lexsort((id[at], -n[at], *(k[at] for k in reversed(keys))))]
        if not len(order):
            return order, order, order, order
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(order)])
        return order, np.repeat(first, size), np.repeat(size, size), first

    def among(value, take):
        """Own words equal but for the other open code point are near one another."""
        order, start, size, _ = segments((group, value), take)
        keep = size > 1
        best = np.where(np.arange(len(order)) == start, start + 1, start)[keep]
        parts.append((id[order[keep]], size[keep] - 1, n[order[best]], id[order[best]]))

    def against(value, take):
        """Own words are near the shorter word whose open code point is `value`."""
        order, _, size, first = segments((group, value), take)
        short = np.flatnonzero(~own)
        if not len(order) or not len(short):
            return
        # Pairs (group, value) are numbered together to look the short words' segment up.
        code = lambda g, v: g.astype(np.int64) * 0x200000 + v
        heads = code(group[order[first]], value[order[first]])
        wanted = code(group[short], x[short])
        place = np.searchsorted(heads, wanted)
        found = np.flatnonzero((place < len(heads)) & (heads[np.minimum(place, len(heads) - 1)] == wanted))
        short, begin = short[found], first[place[found]]
        count = size[begin]
        parts.append((id[short], count, n[order[begin]], id[order[begin]]))
        member = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        partner = np.repeat(short, count)
        parts.append((id[order[member]], np.ones(len(member), np.int64), n[partner], id[partner]))

    among(x, own & (y > 0))
    among(y, own)
    # One code point deleted. Where it repeats the one before, the leftmost place is further left.
    against(y, own & (x != before))
    against(x, own & (y > 0) & (y != x))
    return tuple(map(np.concatenate, zip(*parts)))


def _near(batches):
    """Key rows in order -> (id, near, best_n, best_id); the last group waits for the next batch."""
    import numpy as np
    import pyarrow as pa

    names = ["high", "low", "id", "n", "x", "y", "before", "own"]

    def result(columns):
        high, low, *rest = columns
        new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        out = near_sums(group[several], *(c[several] for c in rest))
        return pa.RecordBatch.from_arrays(list(map(pa.array, map(np.int64, out))), names=["id", "near", "best_n", "best_id"])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held:
            columns = list(map(np.concatenate, zip(held, columns)))
        high, low = columns[:2]
        changes = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        cut = changes[-1] + 1 if len(changes) else 0
        if cut:
            yield result([c[:cut] for c in columns])
        held = [c[cut:] for c in columns]
    if held:
        yield result(held)


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(id, root): forms followed to the last by pointer doubling; n at least doubles at each step."""
    roots, turn = forms.select("id", F.col("form_id").alias("root")), 0
    while True:
        after = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = roots.join(after, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        moved = scratch.table(moved, f"roots-{turn}")
        scratch.drop(f"roots-{turn - 1}")
        if not moved.filter("moved").limit(1).count():
            return moved.select("id", "root")
        roots = moved.select("id", "root")


def variant_forms(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dominance: int = DOMINANCE, damage: int | None = None
) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of `min_length` and `min_count`.

    `docs` needs `doc_id` and `text`; other columns are ignored. Null and empty texts have no
    words; a row without id has the empty id; repeated rows count each time. Of near words with
    the same count the first in code-point order is the form. A word without form is its own
    root. An empty table, or one without such words, gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spelling")
    counted = count_words(docs, damage).filter((F.length("word") >= min_length) & (F.col("n") >= min_count))
    # Ids in the order of the words, so that the least id is the first word.
    words = counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    words = scratch.table(words, "words")
    keys = words.mapInArrow(_keys, "high long, low long, id long, n long, x int, y int, before int, own boolean")
    near = keys.repartition("high", "low").sortWithinPartitions("high", "low").mapInArrow(_near, "id long, near long, best_n long, best_id long")
    near = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", -F.col("best_id"))).alias("best"))
    chosen = F.col("best.best_n") >= dominance * F.col("n")
    placed = words.join(near, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, -F.col("best").getField("col2")).alias("form_id"),
        F.when(chosen, F.col("best.best_n")).alias("form_n"),
    )
    placed = scratch.table(placed, "placed")
    roots = _roots(scratch, placed.filter("form_id IS NOT NULL"))
    form = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    last = words.select(F.col("id").alias("root"), F.col("word").alias("last"))
    named = roots.join(last, "root").select("id", "last")
    return (
        placed.join(form, "form_id", "left")
        .join(named, "id", "left")
        .select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
    )
