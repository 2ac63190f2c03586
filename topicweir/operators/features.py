"""Features of a text: n-gram TF-IDF, statistics, keyword counts, attached embeddings."""

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from topicweir.config import TrainSettings
from topicweir.functions.fixed_values import HAN_CLASS, NOT_WORD_OR_SPACE
from topicweir.functions.matching import FEW, keyword_counts
from topicweir.functions.scores import align_width
from topicweir.functions.text import LONG_WORD_TOKEN, process_text, whitespace_words
from topicweir.functions.vectors import entries, vector_size
from topicweir.runtime import Scratch, literal_array, literal_table, per_class_window, write_once
from topicweir.sources.dictionary import KeywordDictionary

STAT_NAMES = [
    "text_length",
    "word_count",
    "avg_word_length",
    "chinese_chars",
    "english_chars",
    "digit_chars",
    "symbol_chars",
    "chinese_ratio",
    "english_ratio",
    "digit_ratio",
]

# Buckets of the counting filter for each n-gram length, per term of the vocabulary. The share that
# the last kept term has of all n-grams hardly depends on the size of the corpus, so a filter of
# this size keeps the rest of a bucket small beside it at every size.
BUCKETS_PER_TERM = 128
LEAST_BUCKETS = 1 << 12
SLICE = 1 << 17  # tokens counted at a time; their arrays stay in the cache


# --- vocabulary ------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Terms in column order with corpus count and document count; at most `max_features` rows."""

    terms: tuple[str, ...]
    tf: tuple[int, ...]
    df: tuple[int, ...]
    n_docs: int
    ngram_max: int

    def to_frame(self, spark) -> DataFrame:
        rows = [(i, t, tf, df) for i, (t, tf, df) in enumerate(zip(self.terms, self.tf, self.df))]
        return literal_table(spark, rows, ["idx", "term", "tf", "df"], ["int", "string", "long", "long"])

    def idf(self) -> Column:
        """ln((1+N)/(1+df)) + 1 for a `df` column."""
        return F.log((F.lit(self.n_docs) + 1) / (F.col("df") + 1)) + 1


def gram_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LONG_WORD_TOKEN), F.lit(1))


def _term_counts(tokens: DataFrame, grams) -> DataFrame:
    """Corpus count and document count per term, from the counts that `grams` makes of whole rows at a time."""
    counted = tokens.mapInArrow(grams, "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _power_of_two(n: int) -> int:
    return max(LEAST_BUCKETS, 1 << (max(1, n) - 1).bit_length())


def _token_slices(batches, most: int = SLICE):
    """Arrow batches of token lists, some rows at a time: (distinct tokens, number of each token, its row, tokens from it to the row's end, rows)."""
    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(upto):
            done = int(upto[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + most, "right")))
            ends = upto[begin:end] - done
            coded = pc.dictionary_encode(batch.column(0).slice(begin, end - begin).flatten())
            sizes = np.diff(ends, prepend=0)
            row = np.repeat(np.arange(end - begin), sizes)
            yield coded.dictionary, coded.indices.to_numpy().astype(np.int64), row, ends[row] - np.arange(len(row)), end - begin
            begin = end


def _places(dictionary, numbers, left, ngram_max: int, buckets: int):
    """For each n-gram length the places where n-grams begin, and their buckets."""
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, dictionary.to_pylist()), np.uint64, len(dictionary))[numbers]
    mixed = words.copy()
    for size in range(1, ngram_max + 1):
        at = np.flatnonzero(left >= size)
        if size > 1:
            mixed[at] = (mixed[at] ^ mixed[at] >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + words[at + size - 1]
        value = mixed[at] * np.uint64(0xD6E8FEB86659FD93)
        yield size, at, ((value ^ value >> np.uint64(32)) & np.uint64(buckets - 1)).astype(np.int64)


def _bucket_counts(ngram_max: int, buckets: int):
    """Token lists -> how many n-grams fall into each bucket, once per task."""

    def run(batches):
        totals = np.zeros(ngram_max * buckets, np.int64)
        for dictionary, numbers, _, left, _ in _token_slices(batches):
            for size, _, bucket in _places(dictionary, numbers, left, ngram_max, buckets):
                totals[(size - 1) * buckets : size * buckets] += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], names=["bucket", "n"])

    return run


def _marked_grams(marked: dict[int, Iterable[int]], buckets: int):
    """Token lists -> counts of the n-grams in marked buckets, some rows at a time; all others are never written out."""
    bits = {}
    for size, members in marked.items():
        known = np.zeros(buckets, np.uint8)
        known[list(members)] = 1
        bits[size] = np.packbits(known)

    def run(batches):
        marks = {size: np.unpackbits(b).view(bool) for size, b in bits.items()}
        for dictionary, numbers, row, left, rows in _token_slices(batches):
            for size, at, bucket in _places(dictionary, numbers, left, max(marks), buckets):
                at = at[marks[size][bucket]]
                if not len(at):
                    continue
                # The n-grams by number, exactly: those of the first tokens, numbered anew with each further token.
                gram = numbers[at]
                for k in range(1, size):
                    gram = np.unique(gram, return_inverse=True)[1] * len(dictionary) + numbers[at + k]
                _, first, gram, uses = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
                in_docs = np.bincount(np.unique(gram * rows + row[at]) // rows, minlength=len(uses))
                tokens = [dictionary.take(pa.array(numbers[at[first] + k])) for k in range(size)]
                term = pc.binary_join_element_wise(*tokens, " ")
                yield pa.RecordBatch.from_arrays([term, pa.array(uses), pa.array(in_docs)], names=["term", "tf", "df"])

    return run


def fit_vocabulary(
    df: DataFrame,
    text: str = "text",
    ngram_max: int = 4,
    min_df: int = 2,
    max_df: float = 0.9,
    max_features: int = 1500,
) -> Vocabulary:
    """The `max_features` most frequent word 1..n-grams within the document-count limits.

    Ties go to the smaller term. Nearly every long n-gram occurs once, so counting them all by
    their words would shuffle several times the text. Instead all are counted by hash first, in a
    table of fixed size; a bucket's count is no less than that of any n-gram in it. Then only
    n-grams in buckets above a bound are counted by their words. If `max_features` of them reach
    the bound, no other can be among the result; else the bound is halved. Counts are exact. Both
    are added up in the tasks over numbered tokens, so neither hashes nor n-grams become rows one by one.
    """
    buckets = _power_of_two(BUCKETS_PER_TERM * max_features)
    sizes = range(1, ngram_max + 1)
    with Scratch(df.sparkSession, "vocabulary") as scratch:
        tokens = scratch.table(df.select(gram_tokens(F.col(text)).alias("_n1")), "tokens")
        n_docs = tokens.count()
        in_range = (F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)
        places = tokens.mapInArrow(_bucket_counts(ngram_max, buckets), "bucket long, n long")
        table = scratch.table(places.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
        leading = table.orderBy(F.col("n").desc()).limit(2 * max_features)
        bound, found = leading.agg(F.min("n"), F.count(F.lit(1))).first()
        bound = bound if found == 2 * max_features else 1
        while True:
            marked = {n: [] for n in sizes}
            # At most the buckets of the table, a fixed number.
            for row in table.filter(F.col("n") >= bound).select("bucket").toLocalIterator():
                marked[row.bucket // buckets + 1].append(row.bucket % buckets)
            counts = _term_counts(tokens, _marked_grams(marked, buckets)).filter(in_range)
            top = counts.orderBy(F.col("tf").desc(), "term").limit(max_features).collect()
            if bound == 1 or (len(top) == max_features and top[-1].tf >= bound):
                break
            bound = max(1, bound // 2)
    if not top:
        raise ValueError("no terms remain: lower min_df or raise max_df")
    rows = sorted(top, key=lambda r: r.term.encode())
    return Vocabulary(
        tuple(r.term for r in rows), tuple(r.tf for r in rows), tuple(r.df for r in rows), n_docs, ngram_max
    )


class _Trie:
    """Terms as paths of numbered tokens; an edge is the number of its node times that of all tokens, plus its token."""

    def __init__(self, terms: Sequence[str]):
        self.tokens = sorted({t for term in terms for t in term.split(" ")})
        number = {t: i for i, t in enumerate(self.tokens)}
        edges: dict[int, int] = {}
        ends = {}
        for column, term in enumerate(terms):
            node = 0
            for token in term.split(" "):
                node = edges.setdefault(node * len(number) + number[token], len(edges) + 1)
            ends[node] = column
        self.depth = max((term.count(" ") + 1 for term in terms), default=0)
        self.edges = np.array(sorted(edges), np.int64)
        self.nodes = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.column = np.full(len(edges) + 1, -1, np.int64)
        self.column[list(ends)] = list(ends.values())

    def found(self, dictionary, numbers, left):
        """Places where terms begin and the columns of the terms, one pair of arrays per length."""
        known = pc.fill_null(pc.index_in(dictionary, value_set=pa.array(self.tokens, pa.string())), -1).to_numpy().astype(np.int64)[numbers]
        at, node = np.arange(len(numbers)), np.zeros(len(numbers), np.int64)
        for size in range(1, self.depth + 1):
            inside = left[at] >= size
            at, node = at[inside], node[inside]
            token = known[at + size - 1]
            edge = node * len(self.tokens) + token
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            there = (token >= 0) & (self.edges[place] == edge)
            at, node = at[there], self.nodes[place[there]]
            column = self.column[node]
            yield at[column >= 0], column[column >= 0]


def _weigher(terms: Sequence[str], idf: Sequence[float]):
    """Token lists -> tf * idf of unit length, as sparse vectors."""
    trie, weights, width = _Trie(terms), np.array(idf), max(1, len(terms))

    def run(tokens: pa.Array) -> pa.Array:
        sizes, indices, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        rows = 0
        for dictionary, numbers, row, left, n in _token_slices([pa.RecordBatch.from_arrays([tokens], ["tokens"])]):
            places = [row[at] * width + column for at, column in trie.found(dictionary, numbers, left)]
            cells, uses = np.unique(np.concatenate(places or [np.zeros(0, np.int64)]), return_counts=True)
            of, column = np.divmod(cells, width)
            value = uses * weights[column]
            norm = np.sqrt(np.bincount(of, value * value, n))
            sizes.append(np.bincount(of, minlength=n))
            indices.append(column)
            values.append(value / norm[of])
            rows += n
        offsets = pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32())
        parts = {
            "type": pa.array(np.zeros(rows, np.int8)),
            "size": pa.array(np.full(rows, len(terms), np.int32)),
            "indices": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(indices), pa.int32())),
            "values": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))),
        }
        return pa.StructArray.from_arrays(list(parts.values()), list(parts))

    return run


class TfidfModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds tf * idf of the known n-grams of a text, with unit row length; narrow, and vectors stay sparse.

    The n-grams are walked as paths over the numbered tokens of many rows at once, so a row's
    n-grams are never written out as strings. A null text has none.
    """

    state = Param(Params._dummy(), "state", "terms, weights and column names as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, terms: Sequence[str], idf: Sequence[float], text: str, output: str) -> "TfidfModel":
        model = cls()
        model._set(state=json.dumps({"terms": list(terms), "idf": list(idf), "text": text, "output": output}))
        return model

    def _transform(self, df: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault(self.state))
        vector = F.arrow_udf(_weigher(s["terms"], s["idf"]), VectorUDT())(gram_tokens(F.col(s["text"])))
        width = {"ml_attr": {"num_attrs": len(s["terms"])}}
        return df.withColumn(s["output"], vector).withMetadata(s["output"], width)


def tfidf_pipeline(vocabulary: Vocabulary, text: str = "text", output: str = "tfidf") -> PipelineModel:
    """tf * idf with unit row length."""
    idf = [math.log((1 + vocabulary.n_docs) / (1 + d)) + 1 for d in vocabulary.df]
    return PipelineModel([TfidfModel.of(vocabulary.terms, idf, text, output)])


def tfidf_transform(df: DataFrame, vocabulary: Vocabulary, text: str = "text", output: str = "tfidf") -> DataFrame:
    return tfidf_pipeline(vocabulary, text, output).transform(df)


def vector_entries(df: DataFrame, vector: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Non-zero entries of a vector column as rows (keys, name, value)."""
    labels = literal_array(list(names))
    cells = df.select(*keys, F.inline(entries(vector)).alias("_i", "value"))
    return cells.select(*keys, F.get(labels, F.col("_i")).alias("term"), "value")


# --- statistics and keyword counts -------------------------------------------------------


def stat_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Ten length, word, script and symbol measures of the text, as columns."""
    body = F.coalesce(F.col(text), F.lit(""))

    def chars(pattern: str) -> Column:
        return F.length(body) - F.length(F.regexp_replace(body, pattern, ""))

    out = df.withColumns(
        {
            "text_length": F.length(body),
            "word_count": F.size(whitespace_words(body)),
            "chinese_chars": chars(f"[{HAN_CLASS}]+"),
            "english_chars": chars("[a-zA-Z]+"),
            "digit_chars": chars(r"\p{Nd}+"),
            "symbol_chars": chars(f"{NOT_WORD_OR_SPACE}+"),
        }
    )
    length = F.greatest(F.col("text_length"), F.lit(1))
    out = out.withColumns(
        {
            "avg_word_length": F.col("text_length") / F.greatest(F.col("word_count"), F.lit(1)),
            "chinese_ratio": F.col("chinese_chars") / length,
            "english_ratio": F.col("english_chars") / length,
            "digit_ratio": F.col("digit_chars") / length,
        }
    )
    return out.select(*df.columns, *STAT_NAMES)


def stat_array() -> Column:
    return F.array(*[F.col(n).cast("double") for n in STAT_NAMES])


def keyword_features(
    df: DataFrame,
    dictionary: KeywordDictionary,
    text: str = "text",
    output: str = "keyword_counts",
    lower_keywords: bool = False,
) -> DataFrame:
    """One count per subject of entries found in the lower-cased text.

    Entries are taken as they are unless `lower_keywords`, so upper-case ones find nothing.
    """
    packed = dictionary.lowered() if lower_keywords else dictionary
    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    return low.withColumn(output, keyword_counts(F.col("_low"), packed, FEW)).drop("_low")


def light_features(
    df: DataFrame, dictionary: KeywordDictionary, width: int = 100, text: str = "text", output: str = "light"
) -> DataFrame:
    """Keyword counts in the first slots of a fixed-width array."""
    counted = keyword_features(df, dictionary, text, output)
    return counted.withColumn(output, align_width(F.col(output), width))


def attach_embeddings(
    df: DataFrame, embeddings: DataFrame, width: int, key: str = "doc_id", vec_key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """Join a precomputed embedding per document; zeros where there is none."""
    side = embeddings.select(F.col(vec_key).alias(key), F.col(column).cast("array<double>").alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.join(side, key, "left").withColumns(
        {"has_embedding": F.col("embedding").isNotNull(), "embedding": F.coalesce("embedding", zeros)}
    )


# --- assembly and selection --------------------------------------------------------------


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """One vector from numeric, array and vector columns, in order."""
    arrays = {c: array_to_vector(F.col(c).cast("array<double>")) for c in columns
              if df.schema[c].dataType.typeName() == "array"}
    ready = df.withColumns({f"_v_{c}": v for c, v in arrays.items()}) if arrays else df
    inputs = [f"_v_{c}" if c in arrays else c for c in columns]
    out = VectorAssembler(inputCols=inputs, outputCol=output).transform(ready)
    return out.drop(*[f"_v_{c}" for c in arrays])


def variance_topk(df: DataFrame, k: int, vector: str = "features") -> DataFrame:
    """The `k` vector positions of greatest population variance: (rank, idx, variance).

    Only entries other than zero are summed up, position by position; the zeros come in at the end
    by their number. One entry more per row counts the rows and holds the width.
    """
    width = F.array(F.struct(F.lit(-1).alias("idx"), vector_size(vector).cast("double").alias("value")))
    cells = df.select(F.inline(F.concat(width, entries(vector))))
    sums = cells.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("spread"), F.max("value").alias("most")
    )
    sums = write_once(sums, "variance")  # a row per position
    total = sums.filter("idx = -1").first()
    rows, positions = (total.n, int(total.most)) if total else (0, 0)
    every = df.sparkSession.range(positions).select(F.col("id").cast("int").alias("idx"))
    zeros = (F.lit(rows) - F.col("n")) / F.lit(max(rows, 1))
    share = F.col("n") / F.lit(max(rows, 1))
    variance = F.coalesce(share * F.col("spread") + share * zeros * F.col("mean") * F.col("mean"), F.lit(0.0))
    top = every.join(sums, "idx", "left").select("idx", variance.alias("variance"))
    top = top.orderBy(F.col("variance").desc(), "idx").limit(k)
    order = per_class_window().orderBy(F.col("variance").desc(), "idx")
    return top.select(F.row_number().over(order).alias("rank"), "idx", "variance")


def apply_selection(df: DataFrame, indices: Sequence[int], vector: str = "features", output: str = "selected") -> DataFrame:
    """Keep the given positions of a vector, in the given order."""
    return VectorSlicer(inputCol=vector, outputCol=output, indices=list(indices)).transform(df)


def coefficient_table(model, spark) -> DataFrame:
    """(class, feature, value) of a fitted linear model, binary, multinomial or one-vs-rest."""
    rows = []
    parts = getattr(model, "models", None)
    if parts is not None:
        rows = [(c, i, float(v)) for c, m in enumerate(parts) for i, v in enumerate(m.coefficients)]
    else:
        matrix = model.coefficientMatrix.toArray()
        rows = [(c, i, float(v)) for c, line in enumerate(matrix) for i, v in enumerate(line)]
    return spark.createDataFrame(rows, "class int, feature int, value double")


def feature_importance(coefficients: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean over classes of the absolute coefficient, by feature name.

    Empty where the coefficients do not match the names one to one.
    """
    labels = literal_array(list(names))
    weights = coefficients.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    return (
        weights.withColumn("_width", F.count(F.lit(1)).over(per_class_window()))
        .filter(F.col("_width") == len(names))
        .select("feature", F.get(labels, F.col("feature")).alias("name"), "importance")
    )


def tree_importance(model, names: Sequence[str], spark) -> DataFrame:
    """Importances of a fitted tree ensemble; for one-vs-rest the mean over its models."""
    parts = getattr(model, "models", None) or [model]
    arrays = [m.featureImportances.toArray() for m in parts]
    mean = sum(arrays) / len(arrays)
    if len(names) != len(mean):
        return spark.createDataFrame([], "feature int, name string, importance double")
    return spark.createDataFrame(
        [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, mean))], "feature int, name string, importance double"
    )


# --- the whole feature model ---------------------------------------------------------------


@dataclass(frozen=True)
class FeatureModel:
    """Fitted features: what training learned is reused unchanged on new rows."""

    vocabulary: Vocabulary
    dictionary: KeywordDictionary
    embedding_width: int = 0
    selected: tuple[int, ...] | None = None
    terms: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        every = [*self.vocabulary.terms, *STAT_NAMES, *self.dictionary.subjects]
        every += [f"embedding_{i}" for i in range(self.embedding_width)]
        return every if self.selected is None else [every[i] for i in self.selected]

    def _assembled(self, df: DataFrame, text: str, processed: bool) -> DataFrame:
        body = F.coalesce(F.col(text), F.lit("")) if processed else process_text(F.col(text), terms=self.terms)
        out = stat_features(df.withColumn("_processed", body), "_processed").withColumn("_stats", stat_array())
        out = keyword_features(out, self.dictionary, "_processed", "_keywords")
        out = tfidf_transform(out, self.vocabulary, "_processed", "_tfidf")
        parts = ["_tfidf", "_stats", "_keywords"] + (["embedding"] if self.embedding_width else [])
        return assemble(out, parts, "features").select(*df.columns, "features")

    def transform(self, df: DataFrame, text: str = "text", processed: bool = False) -> DataFrame:
        """Add `features`; `processed` says that `text` already went through `process_text`."""
        out = self._assembled(df, text, processed)
        if self.selected is None:
            return out
        sliced = apply_selection(out, self.selected, "features", "_selected")
        return sliced.drop("features").withColumnRenamed("_selected", "features")


def fit_features(
    df: DataFrame,
    dictionary: KeywordDictionary,
    text: str = "text",
    processed: bool = False,
    embedding_width: int = 0,
    cfg: TrainSettings = TrainSettings(),
    terms: Sequence[str] = (),
) -> FeatureModel:
    """Learn the vocabulary and, where the width exceeds `selected_features`, the kept positions."""
    # several passes read the words, so they are cleaned once and written
    words = df if processed else write_once(df.select(process_text(F.col(text), terms=terms).alias(text)), "words")
    vocabulary = fit_vocabulary(words, text, cfg.ngram_max, cfg.min_df, cfg.max_df, cfg.max_features)
    model = FeatureModel(vocabulary, dictionary, embedding_width, None, tuple(terms))
    if len(model.names) <= cfg.selected_features:
        return model
    kept = variance_topk(model.transform(df, text, processed), cfg.selected_features).collect()
    return FeatureModel(vocabulary, dictionary, embedding_width, tuple(r.idx for r in kept), tuple(terms))
