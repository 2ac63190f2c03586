"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the words of all items. Document words stream through it and the
longest match is tracked; where it reaches the length of a registered window (ten words of an
item, or a whole shorter item), the window's words are hit. Items are dealt into blocks of
bounded size, each with an automaton of its own, and a pass
takes a bounded number of blocks, so a large test set needs more passes but never more memory. Documents never leave their task: there is no shuffle.
"""

import re

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from topicweir.llm.common import tidy, worker_state

WINDOW = 10
MAX_COVERAGE = 0.8
BLOCK_BYTES = 500_000
PASS_BYTES = 2_000_000  # the automata of one pass are in a worker at the same time

# A-Z to a-z; ASCII other than letters and digits to blanks; all other bytes stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows registered at their states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(cs)) for _, cs in coded), default=0)
        self.owners: dict[int, dict[int, list[str]]] = {}
        for item, codes in coded:
            size, state = min(window, len(codes)), 0
            for n, c in enumerate(codes, 1):
                state = self.next[state][c]
                while self.length[self.link[state]] >= size and state:
                    state = self.link[state]
                if n >= size:
                    held = self.owners.setdefault(state, {}).setdefault(size, [])
                    if item not in held:
                        held.append(item)
        # The nearest state on the way to the root, itself included, where a window is registered.
        self.near = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[s] = s if s in self.owners else self.near[self.link[s]]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive) covered by registered windows, in order, and their items.

        A word that no item has ends every match, so only runs of known words that can hold
        the shortest window are walked.
        """
        spans, items = [], set()
        known = bytes(map(self.vocabulary.__contains__, words))
        for run in re.finditer(b"\x01{%d,}" % max(1, self.shortest), known):
            state = matched = 0
            for at in range(run.start(), run.end()):
                c = self.vocabulary[words[at]]
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    matched += 1
                reach, u = 0, self.near[state]
                while u:
                    for size, owners in self.owners[u].items():
                        if size <= matched:
                            reach = max(reach, size)
                            items.update(owners)
                    u = self.near[self.link[u]]
                if reach:
                    begin = at + 1 - reach
                    if spans and begin <= spans[-1][1]:
                        spans[-1] = (min(begin, spans[-1][0]), at + 1)
                    else:
                        spans.append((begin, at + 1))
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the characters from the first to the last word of each word range."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_FOLD))]
    out, at = [], 0
    for begin, end in spans:
        out.append(data[at : places[begin][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _scan(blocks: list[tuple[str, list[tuple[str, str]]]], window: int):
    def run(batches):
        import pyarrow as pa

        built = worker_state("automata", dict)
        wanted = {(window, key) for key, _ in blocks}
        for old in built.keys() - wanted:
            del built[old]

        def automaton(key, items):
            if (window, key) not in built:
                built[window, key] = Automaton([(i, ws) for i, t in items if (ws := words_of(t))], window)
            return built[window, key]

        for batch in batches:
            texts = batch.column("text").to_pylist()
            before = batch.column("_spans").to_pylist()
            items = [set(x) for x in batch.column("_items").to_pylist()]
            words, spans = [], [[(s["begin"], s["end"]) for s in b] for b in before]
            for row, text in enumerate(texts):
                own = words_of(text or "")
                words.append(len(own))
                for key, block in blocks:
                    found, names = automaton(key, block).match(own)
                    if found:
                        spans[row] = _merged(spans[row] + found)
                        items[row] |= names
            new = {
                "_words": pa.array(words, pa.int64()),
                "_spans": pa.array(
                    [[{"begin": b, "end": e} for b, e in s] for s in spans],
                    pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])),
                ),
                "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return tidy("automata", run)


def _passes(items: DataFrame, block_bytes: int, pass_bytes: int):
    """Lists of blocks of (item id as string, text); each list is at most `pass_bytes` long."""
    import hashlib

    blocks, block, held, passed = [], [], 0, 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        size = len(r.t) + 16
        if block and held + size > block_bytes:
            blocks.append(block)
            block, held = [], 0
            if passed > pass_bytes:
                yield [(hashlib.sha256(repr(b).encode()).hexdigest(), b) for b in blocks]
                blocks, passed = [], 0
        block.append((str(r.i), r.t))
        held, passed = held + size, passed + size
    blocks += [block] if block else []
    yield [(hashlib.sha256(repr(b).encode()).hexdigest(), b) for b in blocks]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """`docs` with `_words` (count), `_spans` (merged hit word ranges) and `_items` (sorted ids).

    All columns of `docs` stay; `text` is needed. A null text has no words. An empty table, or
    items without words, give no hits. Items with the same text are all named.
    """
    out = docs.withColumns(
        {
            "_words": F.lit(0).cast("long"),
            "_spans": F.expr("CAST(array() AS array<struct<begin: int, end: int>>)"),
            "_items": F.expr("CAST(array() AS array<string>)"),
        }
    )
    schema = StructType([f for f in out.schema.fields])
    for f in schema.fields:
        f.nullable = True
    for blocks in _passes(items, block_bytes, pass_bytes):
        out = out.mapInArrow(_scan(blocks, window), schema)
    return out


def leak_report(found: DataFrame) -> DataFrame:
    """One row per document of `find_leaks`: counts, digest of the items, verdict."""
    hits = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def _remove(batches):
    import pyarrow as pa

    for batch in batches:
        spans = batch.column("_spans").to_pylist()
        texts = [
            without_spans(t, [(s["begin"], s["end"]) for s in p]) if p else t
            for t, p in zip(batch.column("text").to_pylist(), spans)
        ]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names
        )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, **blocks
) -> DataFrame:
    """`docs` without leaked spans; documents with at least `max_coverage` of their words hit go.

    Every span of `window` or more item words is cut out of `text`; other columns stay as they are.
    """
    found = find_leaks(docs, items, window, **blocks)
    hits = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]))
    kept = found.filter((F.size("_spans") == 0) | (hits < F.lit(max_coverage) * F.col("_words")))
    return kept.mapInArrow(tidy("automata", _remove), kept.schema).select(*docs.columns)
