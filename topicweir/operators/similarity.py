"""Pairs of similar texts from two tables, by their sets of processed tokens."""

from pyspark.sql import Column, DataFrame, functions as F

from topicweir.functions.text import processed_tokens
from topicweir.runtime import Scratch, literal_array

BUCKETS = 1 << 15  # of token hashes, whose uses are counted
BROADCAST = 1 << 19  # tokens of a right table that is sent to all tasks; a larger one is shuffled


def token_sets(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, tokens, size) of every row with tokens; the tokens are distinct."""
    rows = df.select(F.col(id_col).alias("id"), F.array_distinct(processed_tokens(F.col(text))).alias("tokens"))
    return rows.filter(F.size("tokens") > 0).withColumn("size", F.size("tokens"))


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _order(one: DataFrame, two: DataFrame) -> list[int]:
    """For each bucket of tokens its place in the order from rare to frequent, 0 where a side has no token in it."""
    uses = [
        s.select(F.explode("tokens").alias("token")).select(_bucket(F.col("token")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
        for s, name in ((one, "x"), (two, "y"))
    ]
    order = [0] * BUCKETS
    for place, row in enumerate(uses[0].join(uses[1], "bucket").orderBy(F.col("x") * F.col("y"), "bucket").collect(), 1):
        order[row.bucket] = place
    return order


def _shared(order: Column) -> Column:
    return F.filter("tokens", lambda t: F.get(order, _bucket(t)) > 0)


def _prefixes(sets: DataFrame, order: Column, threshold: float) -> DataFrame:
    """(id, size, token): of each set the rarest tokens, as many as a partner must meet; those of one side only are left out.

    Sets of similarity t share at least ceil(t * n) of the n tokens of either, so they share one of
    its first n - ceil(t * n) + 1 tokens in any common order.
    """
    ordered = F.sort_array(F.transform("tokens", lambda t: F.struct(F.get(order, _bucket(t)).alias("place"), t.alias("token"))))
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    return sets.select("id", "size", F.inline(F.filter(F.slice(ordered, 1, length), lambda t: t["place"] > 0))).drop("place")


def similar_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    left_id: str = "doc_id",
    right_id: str = "item_id",
    left_text: str = "text",
    right_text: str = "text",
) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs with a Jaccard similarity of at least `threshold`.

    Ids are unique in each table and not null. The sets meet in an inverted index of their rarest
    tokens, where sizes that rule a link out are dropped; what meets is verified on the full sets.
    Texts without tokens are in no pair. `threshold` is above 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    scratch = Scratch(left.sparkSession, "similar")
    one = scratch.table(token_sets(left, left_id, left_text), "left")
    two = scratch.table(token_sets(right, right_id, right_text), "right")
    # Only tokens of both sides can make a pair. They are ordered by the uses of their buckets, in the
    # row, so no token is shuffled to learn its count.
    order = literal_array(_order(one, two), "int")
    a = _prefixes(one, order, threshold).toDF("a", "a_size", "token")
    b = _prefixes(two, order, threshold).toDF("b", "b_size", "token")
    fits = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-9
    met = scratch.table(a.join(b, "token").filter(fits).select("a", "b").distinct(), "met")

    # For the intersection, tokens of one side only count by their number.
    left_sets = one.select(F.col("id").alias("a"), F.col("size").alias("m"), _shared(order).alias("x"))
    right_sets = two.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("y"))
    if (two.agg(F.sum("size")).first()[0] or 0) <= BROADCAST:
        sides = met.join(left_sets, "a").join(F.broadcast(right_sets), "b")
    else:
        sides = met.join(right_sets, "b").join(left_sets, "a")
    both = F.size(F.array_intersect("x", "y"))
    rows = sides.select("a", "b", "m", "n", both.alias("both"))
    similarity = F.col("both") / (F.col("m") + F.col("n") - F.col("both"))
    rows = rows.select(F.col("a").alias(left_id), F.col("b").alias(right_id), similarity.alias("similarity"))
    return rows.filter(F.col("similarity") >= threshold)
