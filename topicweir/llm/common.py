"""Helpers of the corpus operators: table access, worker-side caches, word splitting."""

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words of the shingle and window operators: runs of anything but ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_rows(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` alone, with null texts as empty ones; other columns never get in the way."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _held() -> dict:
    """Values of this Python worker.

    Functions travel to the tasks by value, so their module globals are new in each task; a module
    registered in the worker's own `sys.modules` is not.
    """
    return sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state")).__dict__.setdefault("held", {})


def _give_back():
    """Return freed memory to the system; Arrow's and the C library's allocators keep it otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def own_worker(owner: str) -> None:
    """From here on the worker keeps values of `owner` only; those of other operators go."""
    held = _held()
    if any(k.split(":")[0] != owner for k in held):
        held.clear()
        _give_back()


def worker_state(key: str, build):
    """A value kept in a Python worker for its next tasks, such as a loaded tokenizer.

    Workers outlive a stage, so keys are `owner:name` and only one owner's values are kept.
    """
    own_worker(key.split(":")[0])
    held = _held()
    if key not in held:
        held[key] = build()
    return held[key]


def tidy(owner: str, run):
    """An Arrow function for tasks that drops other operators' values first and gives its memory back at the end."""

    def tidied(batches):
        own_worker(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


class Recent(dict):
    """Values by key in two generations: when one has `size` entries it becomes the old one.

    What is looked up again moves to the new generation, so frequent keys stay and no more than
    twice `size` entries are held, none with a key longer than `LONGEST`.
    """

    LONGEST = 64

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def load_tokenizer(path: str, owner: str):
    """The tokenizer file `path`, loaded once per worker, on one thread."""

    def build():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return worker_state(f"{owner}:tokenizer:{path}", build)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordHashes(Recent):
    """64-bit hash of a word (bytes), computed once while it is held."""

    def __init__(self, size: int = 100_000):
        import xxhash

        super().__init__(xxhash.xxh3_64_intdigest, size)

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def sequence_hashes(words, size: int):
    """64-bit hashes of all runs of `size` consecutive word hashes (numpy, unsigned)."""
    import numpy as np

    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    mixed = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        mixed ^= words[i : i + n]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed
