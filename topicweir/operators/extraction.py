"""Deck text from slide rows."""

from pyspark.sql import DataFrame, Window, functions as F

from topicweir.functions.fixed_values import SLIDES_CLASSIFY, SLIDES_DEFAULT


def first_slides(slides: DataFrame, max_slides: int, deck: str = "path", idx: str = "slide_idx") -> DataFrame:
    """The first slides of each deck by index.

    The rank filter is applied before the shuffle too (window group limit), so a deck
    with very many slide rows sends at most `max_slides` of them per input partition.
    """
    order = Window.partitionBy(deck).orderBy(idx)
    return slides.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= max_slides).drop("_rn")


def joined_text(idx: str, text: str):
    """Aggregate: non-empty texts in index order, joined with a space."""
    filled = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(F.col(idx), F.col(text)))
    return F.array_join(F.transform(F.sort_array(F.collect_list(filled)), lambda s: s[text]), " ")


def deck_text(
    slides: DataFrame,
    max_slides: int = SLIDES_DEFAULT,
    deck: str = "path",
    idx: str = "slide_idx",
    text: str = "text",
) -> DataFrame:
    """One text per deck: the first slides in order, empty ones dropped, joined with a space."""
    return (
        first_slides(slides.select(deck, idx, text), max_slides, deck, idx)
        .groupBy(deck)
        .agg(joined_text(idx, text).alias("text"))
    )


def slide_count(decks: DataFrame, slides: DataFrame, deck: str = "path") -> DataFrame:
    """Slides per deck, 0 for a deck without readable slides."""
    counts = slides.groupBy(deck).agg(F.count(F.lit(1)).alias("slides"))
    return decks.select(deck).join(counts, deck, "left").withColumn("slides", F.coalesce("slides", F.lit(0)))


def extract_corpus(
    decks: DataFrame,
    slides: DataFrame,
    saved: DataFrame | None = None,
    max_slides: int = SLIDES_CLASSIFY,
    deck: str = "path",
    idx: str = "slide_idx",
    text: str = "text",
) -> DataFrame:
    """Text for every deck; a deck that failed keeps its row with an empty text.

    `saved` holds texts of an earlier run (deck, text); those decks are not assembled again.
    Slides are cut to the first ones before decks are matched, so a deck with very many slide
    rows is small by then; ranking, matching and grouping share one partitioning by deck.
    """
    if saved is not None:
        flagged = slides.select(deck, idx, text).join(saved.select(deck), deck, "left_anti")
    else:
        flagged = slides.select(deck, idx, text)
    fresh = deck_text(flagged, max_slides, deck, idx, text)
    out = decks.select(deck).join(fresh, deck, "left")
    if saved is None:
        return out.select(deck, F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("reused"))
    kept = saved.select(deck, F.col("text").alias("_saved"), F.lit(True).alias("_reused"))
    return out.join(kept, deck, "left").select(
        deck,
        F.coalesce("_saved", "text", F.lit("")).alias("text"),
        F.coalesce("_reused", F.lit(False)).alias("reused"),
    )
