"""Keywords per class and quality of keyword dictionaries (long tables, see sources.dictionary)."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from topicweir.functions.fixed_values import HAN_CLASS, STOPWORDS, SUBJECT_DESCRIPTIONS
from topicweir.functions.matching import own_class_count
from topicweir.functions.text import processed_tokens, whitespace_words, word_tokens
from topicweir.operators.dataset import subject_table
from topicweir.runtime import literal_table, number_within, settle
from topicweir.sources.dictionary import KeywordDictionary

MERGED_PER_SUBJECT = 50


def doc_keywords(
    df: DataFrame,
    n: int = 20,
    id_col: str = "doc_id",
    text: str = "text",
    stop: Sequence[str] = tuple(STOPWORDS),
) -> DataFrame:
    """Most frequent processed tokens of each document; a tie goes to the earlier first use.

    A document is one row, so its tokens are sorted, counted by run length and ranked inside
    that row: nothing is shuffled.
    """

    usable = F.filter(processed_tokens(F.col(text), stop), lambda t: (F.length(t) >= 2) & ~t.isin(list(stop)))
    pairs = F.transform(usable, lambda t, i: F.struct(t.alias("token"), i.alias("at")))
    rows = settle(df.select(id_col, F.sort_array(pairs).alias("_sorted")), "_sorted")
    # plain arrays from here on: reading a struct out of an array for every token costs twice the time
    rows = settle(rows.select(id_col, F.col("_sorted.token").alias("_token"), F.col("_sorted.at").alias("_at")), "_token", "_at")

    size = F.size("_token")
    positions = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    starts = F.filter(positions, lambda i: (i == 0) | (F.get("_token", i) != F.get("_token", i - 1)))
    rows = settle(rows.withColumn("_starts", starts), "_starts")

    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), size)
        return F.struct((start - end).alias("neg"), F.get("_at", start).alias("at"), start.alias("start"))

    ranked = F.slice(F.sort_array(F.transform("_starts", run)), 1, n)
    entries = rows.select(
        id_col,
        F.posexplode(
            F.transform(ranked, lambda e: F.struct(e["neg"].alias("neg"), F.get("_token", e["start"]).alias("token")))
        ).alias("_r", "_e"),
    )
    return entries.select(
        id_col,
        (F.col("_r") + 1).alias("rank"),
        F.col("_e.token").alias("token"),
        (-F.col("_e.neg")).cast("long").alias("n"),
    )


def class_keywords(
    df: DataFrame,
    subjects: Sequence[str],
    n: int | None = 30,
    label: str = "label",
    text: str = "text",
    stop: Sequence[str] = tuple(STOPWORDS),
    max_terms: int | None = None,
) -> DataFrame:
    """The `n` most frequent terms per class as a dictionary table with counts; all terms for `n` None.

    `max_terms` puts a further bound on every class, for callers that keep a fixed vocabulary size.

    One class can hold most of the rows: counts are combined before the shuffle, and the rank
    filter trims every partition to the leading terms before a class meets in one task.
    """
    rows = df.filter(F.col(label).isin(list(subjects)))
    terms = rows.select(label, F.explode(word_tokens(F.col(text))).alias("keyword"))
    counts = terms.filter(~F.col("keyword").isin(list(stop))).groupBy(label, "keyword").agg(
        F.count(F.lit(1)).alias("n")
    )
    bounds = [b for b in (n, max_terms) if b is not None]
    if bounds:
        order = Window.partitionBy(label).orderBy(F.col("n").desc(), "keyword")
        ranked = counts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= min(bounds))
    else:  # a class's whole vocabulary need not fit one task
        ranked = number_within(counts, label, F.col("n").desc(), F.col("keyword"), name="_rn")
    table = subject_table(df.sparkSession, subjects, "subject")
    return ranked.withColumnRenamed(label, "subject").join(F.broadcast(table), "subject").select(
        "subject",
        F.col("ord").alias("subject_ord"),
        (F.col("_rn") - 1).alias("kw_ord"),
        "keyword",
        "n",
    )


def segment_terms(dictionary: DataFrame) -> DataFrame:
    """Entries a word segmenter should know: at least two characters, not ASCII only."""
    return dictionary.filter((F.length("keyword") >= 2) & F.col("keyword").rlike(r"[^\x{00}-\x{7f}]"))


def merge_dictionaries(
    old: DataFrame,
    new: DataFrame,
    base: DataFrame,
    subjects: Sequence[str],
    keep_existing: bool = True,
    limit: int = MERGED_PER_SUBJECT,
) -> DataFrame:
    """Union (or replacement) per subject: longer first, base entries first, then by text."""

    def side(df: DataFrame, member: int, in_base: int) -> DataFrame:
        return df.select("subject", "keyword", F.lit(member).alias("_member"), F.lit(in_base).alias("_base"))

    rows = side(new, 1, 0).unionByName(side(base, 0, 1))
    if keep_existing:
        rows = rows.unionByName(side(old, 1, 0))
    merged = (
        rows.filter(F.col("subject").isin(list(subjects)))
        .groupBy("subject", "keyword")
        .agg(F.max("_member").alias("_member"), F.max("_base").alias("_base"))
        .filter(F.col("_member") == 1)
    )
    order = Window.partitionBy("subject").orderBy(F.length("keyword").desc(), F.col("_base").desc(), "keyword")
    ranked = merged.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit)
    table = subject_table(old.sparkSession, subjects, "subject")
    return ranked.join(F.broadcast(table), "subject").select(
        "subject", F.col("ord").alias("subject_ord"), (F.col("_rn") - 1).alias("kw_ord"), "keyword"
    )


def keyword_hit_rate(
    df: DataFrame,
    dictionary: KeywordDictionary,
    label: str = "label",
    text: str = "text",
    lower_keywords: bool = False,
) -> DataFrame:
    """Per class: own keywords found (each once per text) over whitespace words.

    Labels are one per class, so the rated table is small.
    """
    packed = (dictionary.lowered() if lower_keywords else dictionary).distinct()
    low = df.select(F.col(label), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    sums = (
        low.select(
            label,
            own_class_count(F.col("_low"), F.col(label), packed).alias("_hits"),
            F.size(whitespace_words(F.col("_low"))).alias("_words"),
        )
        .groupBy(label)
        .agg(F.sum("_hits").alias("hits"), F.sum("_words").alias("words"))
    )
    rate = F.when(F.col("words") > 0, F.col("hits") / F.col("words")).otherwise(F.lit(0.0))
    rated = sums.withColumn("hit_rate", rate)
    # A subject without texts has its row too, with nothing found.
    named = subject_table(df.sparkSession, packed.subjects, label).select(label)
    missing = named.join(F.broadcast(rated.select(label)), label, "left_anti")
    zero = F.lit(0).cast("long")
    return rated.unionByName(missing.select(label, zero.alias("hits"), zero.alias("words"), F.lit(0.0).alias("hit_rate")))


def dictionary_stats(dictionary: DataFrame, examples: int = 5) -> DataFrame:
    """Per subject: entries, mean length, entries with Han, Latin entries without Han, first entries."""
    han = F.col("keyword").rlike(f"[{HAN_CLASS}]")
    latin = F.col("keyword").rlike("[a-zA-Z]") & ~han
    first = F.when(F.col("kw_ord") < examples, F.struct("kw_ord", "keyword"))
    return dictionary.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.length("keyword")).alias("avg_length"),
        F.sum(han.cast("long")).alias("chinese_count"),
        F.sum(latin.cast("long")).alias("english_count"),
        F.transform(F.sort_array(F.collect_list(first)), lambda e: e["keyword"]).alias("examples"),
    )


def ambiguous_keywords(dictionary: DataFrame) -> DataFrame:
    """Keywords listed more than once, with the subject of every listing, most listed first."""
    per_subject = dictionary.groupBy("keyword", "subject", "subject_ord").agg(
        F.count(F.lit(1)).cast("int").alias("_times"), F.min("kw_ord").alias("_first")
    )
    listing = F.sort_array(F.collect_list(F.struct("subject_ord", "_first", "subject", "_times")))
    grouped = per_subject.groupBy("keyword").agg(F.sum("_times").alias("n"), listing.alias("_in"))
    subjects = F.flatten(F.transform("_in", lambda e: F.array_repeat(e["subject"], e["_times"])))
    first = F.element_at("_in", 1)
    return (
        grouped.filter(F.col("n") > 1)
        .orderBy(F.col("n").desc(), first["subject_ord"], first["_first"])
        .select("keyword", "n", subjects.alias("subjects"))
    )


def export_described(dictionary: DataFrame, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """The dictionary with each subject's description put before its keywords."""
    texts = SUBJECT_DESCRIPTIONS if descriptions is None else descriptions
    rows = dictionary.select("subject", "subject_ord", "kw_ord", "keyword")
    if not texts:
        return rows
    described = literal_table(rows.sparkSession, list(texts.items()), ["subject", "keyword"], ["string", "string"])
    heads = rows.select("subject", "subject_ord").distinct().join(F.broadcast(described), "subject")
    shift = F.col("subject").isin(list(texts)).cast("int")
    return rows.withColumn("kw_ord", F.col("kw_ord") + shift).unionByName(
        heads.select("subject", "subject_ord", F.lit(0).alias("kw_ord"), "keyword")
    )
