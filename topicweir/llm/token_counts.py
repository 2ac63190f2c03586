"""Token counts per document without token ids.

Texts are cut into pre-tokens by Spark's own regular expressions. Every distinct pre-token is
given to the tokenizer once; its piece count is joined to the pre-token frequencies of the
documents and summed. Frequent pre-tokens (at most `head`, each of at most HEAD_BYTES bytes)
are joined by broadcast, so no hot pre-token is ever shuffled; the rare rest is shuffled as one
row per document and pre-token.
"""

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from topicweir.llm.common import load_tokenizer, text_rows
from topicweir.runtime import Scratch

# Fixed value: the pre-token pattern of byte-level vocabularies, with {L} for letters and {N} for numbers.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\p{IsWhite_Space}{L}{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)

HEAD = 200_000
HEAD_BYTES = 64
LIMIT = 1024


def _pieces(path: str):
    def run(batches):
        import pyarrow as pa

        tokenizer = load_tokenizer(path, "token-counts")
        for batch in batches:
            encoded = tokenizer.encode_batch(batch.column("piece").to_pylist(), add_special_tokens=False)
            counts = pa.array([len(e.ids) for e in encoded], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, "tokens"])

    return run


def _chunks(size: int = 8192):
    """All code points but surrogates, as strings."""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    return ["".join(map(chr, points[i : i + size])) for i in range(0, len(points), size)]


def _joining(tokenizer, start: str) -> set[str]:
    """Characters that the tokenizer puts into one pre-token with `start` before them."""
    out = set()
    for chunk in _chunks():
        text = "".join(f"{start}{c}\n" for c in chunk)
        spans = {a: b for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        out |= {c for i, c in enumerate(chunk) if spans.get(3 * i, 0) == 3 * i + 2}
    return out


def _ranges(chars: set[str]) -> str:
    points, out = sorted(map(ord, chars)), []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_SCHEMES: dict[str, tuple] = {}  # by file, for the life of the driver


def scheme(spark: SparkSession, path: str):
    """How the tokenizer file cuts the column `text`: a function from a part of it to its pre-tokens, and the special tokens.

    The tokenizer itself tells which code points are letters and numbers to it; where the JVM's
    tables say otherwise (it may know fewer of the newest letters), the classes name the
    difference. A file that cuts in another way is refused.
    """
    if path not in _SCHEMES:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind = file.get("pre_tokenizer") or {}
        plain = all(not t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or file.get("normalizer") or not plain:
            raise ValueError(f"{path} does not cut texts like a plain byte-level vocabulary")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        own = {"L": _joining(tokenizer, "a"), "N": _joining(tokenizer, "1")}
        rows = spark.createDataFrame([(c,) for c in _chunks()], "chunk string")
        seen = rows.select(*[F.regexp_replace("chunk", rf"\P{{{k}}}", "").alias(k) for k in own]).collect()  # all code points once
        classes, odd = {}, set()
        for k, chars in own.items():
            known = {c for r in seen for c in r[k]}
            odd |= chars ^ known
            classes[k] = f"\\p{{{k}}}{_ranges(chars - known)}", known - chars
        if any(lost for _, lost in classes.values()):
            raise ValueError("the JVM knows letters or numbers that the tokenizer does not")
        _SCHEMES[path] = {k: c for k, (c, _) in classes.items()}, min(map(ord, odd), default=None), [t["content"] for t in file["added_tokens"]]
    classes, least, special = _SCHEMES[path]

    def pieces(text: Column) -> Column:
        def by(letters: str, numbers: str) -> Column:
            return F.regexp_extract_all(text, F.lit(PRETOKEN.replace("{L}", letters).replace("{N}", numbers)), F.lit(0))

        usual = by(r"\p{L}", r"\p{N}")
        if least is None:
            return usual
        # Only texts with code points from the first difference on need the longer classes.
        return F.when(F.col("text").rlike(f"[\\x{{{least:x}}}-\\x{{10ffff}}]"), by(classes["L"], classes["N"])).otherwise(usual)

    return pieces, special


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    `docs` needs `doc_id` and `text`; other columns are ignored. A null text is an empty one and
    has no tokens; every input row gives one row, also when rows or ids repeat. An empty table
    gives an empty result. A special token inside a text counts as one token. A tokenizer file that
    does not cut texts like a plain byte-level vocabulary is refused.
    """
    scratch = Scratch(docs.sparkSession, "token-counts")
    pieces_of, special = scheme(docs.sparkSession, tokenizer_path)
    literal = "|".join(re.sub(r"(\W)", r"\\\1", t) for t in sorted(special, key=len, reverse=True)) or r"(?!)"
    parts = F.split("text", literal, -1)
    cut = F.flatten(F.transform(parts, pieces_of))
    rows = text_rows(docs)

    seen = rows.select(F.explode(cut).alias("piece")).groupBy("piece").agg(F.count("*").alias("seen"))
    pieces = scratch.table(seen.mapInArrow(_pieces(tokenizer_path), "piece string, seen long, tokens long"), "pieces")

    # The least power of two from which on at most `head` pre-tokens are seen so often.
    level = F.floor(F.log2("seen")).cast("int").alias("level")
    short = F.octet_length("piece") <= HEAD_BYTES
    sizes = {r.level: r.n for r in pieces.filter(short).groupBy(level).agg(F.count("*").alias("n")).collect()}
    lowest, held = 63, 0
    while lowest > 0 and held + sizes.get(lowest - 1, 0) <= head:
        lowest -= 1
        held += sizes.get(lowest, 0)
    frequent = pieces.filter(short & (F.col("seen") >= 2**lowest)).select("piece", "tokens")

    # All else is computed before the explosion, so no text is copied along with its pre-tokens.
    # Rows alike in id and text are counted together and parted again at the end.
    keys = ["doc_id", "hash"]
    known = rows.select(
        "doc_id",
        F.xxhash64("text").alias("hash"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.size(parts) - 1).cast("long").alias("n_special"),
        cut.alias("pieces"),
    )
    common = (
        known.select(*keys, "n_bytes", "n_special", F.posexplode_outer("pieces").alias("at", "piece"))
        .join(F.broadcast(frequent), "piece", "left")
        .groupBy(*keys)
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
            F.max("n_bytes").alias("n_bytes"),
            F.max("n_special").alias("n_special"),
        )
    )
    # Dealt out once, by pre-token; frequencies and the join need no further exchange.
    rare = (
        known.select(*keys, F.explode("pieces").alias("piece"))
        .join(F.broadcast(frequent), "piece", "left_anti")
        .repartition("piece")
        .groupBy("piece", *keys)
        .agg(F.count("*").alias("times"))
        .join(pieces.select("piece", "tokens"), "piece")
        .select(*keys, (F.col("tokens") * F.col("times")).alias("tokens"))
    )
    counted = common.unionByName(rare, allowMissingColumns=True).groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"), *[F.max(c).alias(c) for c in ("copies", "n_bytes", "n_special")]
    )
    one = (F.coalesce("tokens", F.lit(0)) / F.col("copies") + F.col("n_special")).cast("long")
    return (
        counted.withColumn("n_tokens", one)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
