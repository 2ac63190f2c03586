"""Text cleaning, token extraction and similarity as column expressions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from topicweir.functions.fixed_values import (
    HAN_CLASS,
    PUNCT_CLASS,
    SPACE,
    SPACE_NOT_PLAIN,
    STOPWORDS,
    STOPWORDS_ENGLISH,
    WORD_CLASS,
)
from topicweir.functions.segmentation import Lattice, pairs
from topicweir.runtime import bind

# Dictionary terms of the segmentation, alone or with their frequencies.
Terms = Sequence[str] | Mapping[str, int]
WORD_TOKEN = f"([{WORD_CLASS}]+)"
LONG_WORD_TOKEN = f"([{WORD_CLASS}]{{2,}})"


def stopwords(custom: Sequence[str] | None = None) -> list[str]:
    """Chinese and layout stop words, with an optional custom list added."""
    return list(dict.fromkeys([*STOPWORDS, *(custom or [])]))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def whitespace_words(col: Column) -> Column:
    """Pieces between runs of whitespace, without empty ones."""
    return F.array_remove(F.split(col, f"{SPACE}+"), "")


def basic_clean(col: Column) -> Column:
    """Lower-case, one kind of space, keep words and basic punctuation, drop punctuation runs."""
    # single plain spaces stay, so only other whitespace and longer runs are replaced
    out = F.regexp_replace(F.lower(col), f"{SPACE_NOT_PLAIN}{SPACE}*| {SPACE}+", " ")
    out = F.regexp_replace(out, f"[^a-z {WORD_CLASS}{HAN_CLASS}{PUNCT_CLASS}]", " ")
    out = F.regexp_replace(out, f"[{PUNCT_CLASS}]{{2,}}", " ")
    return F.trim(out)


def script_runs(col: Column, chars: str = HAN_CLASS) -> Column:
    """Maximal runs of one character class."""
    return F.regexp_extract_all(col, F.lit(f"([{chars}]+)"), F.lit(1))


def extract_chinese(col: Column, chars: str = HAN_CLASS) -> Column:
    return F.array_join(script_runs(col, chars), " ")


def latin_words(col: Column) -> Column:
    """Runs of at least two ASCII letters."""
    return F.regexp_extract_all(col, F.lit("([a-zA-Z]{2,})"), F.lit(1))


def extract_english(col: Column) -> Column:
    return F.array_join(latin_words(col), " ")


def process_english(words: Column) -> Column:
    """Drop English stop words and words under three letters."""
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(STOPWORDS_ENGLISH))


def segment_chinese(
    col: Column,
    terms: Terms = (),
    stop: Sequence[str] = tuple(STOPWORDS),
    chars: str = HAN_CLASS,
) -> Column:
    """Words of every run: dictionary terms on the best path, overlapping pairs of letters elsewhere.

    Every term counts as often as it stands, and no pair reaches into a term. `terms` may have
    frequencies; without terms a run is all pairs.
    """
    runs = F.filter(script_runs(col, chars), lambda r: F.length(r) >= 2)
    words = F.flatten(F.transform(runs, Lattice.of(terms).words if terms else pairs))
    return F.filter(words, lambda w: ~w.isin(list(stop)))


def _tokens(clean: Column, keep_english: bool, terms: Terms, stop: Sequence[str]) -> Column:
    parts = [segment_chinese(clean, terms, stop)]
    if keep_english:
        parts.append(process_english(latin_words(clean)))
    return F.concat(*parts)


def process_text(
    col: Column,
    keep_english: bool = True,
    terms: Terms = (),
    stop: Sequence[str] = tuple(STOPWORDS),
) -> Column:
    """Clean, tokenize both scripts, join; the cleaned text when no token survives."""

    def body(clean: Column) -> Column:
        joined = F.array_join(_tokens(clean, keep_english, terms, stop), " ")
        return bind(joined, lambda j: F.when(j == "", clean).otherwise(j))

    return bind(basic_clean(F.coalesce(col, F.lit(""))), body)


def processed_tokens(col: Column, stop: Sequence[str] = tuple(STOPWORDS)) -> Column:
    """The words of `process_text` as an array, without joining and splitting them again."""

    def body(clean: Column) -> Column:
        words = F.filter(F.split(clean, " "), lambda w: w != "")
        return bind(_tokens(clean, True, (), stop), lambda t: F.when(F.size(t) > 0, t).otherwise(words))

    return bind(basic_clean(F.coalesce(col, F.lit(""))), body)


def word_tokens(col: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD_TOKEN), F.lit(1))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of the processed token sets of two texts, 0.0 if either is empty."""

    def ratio(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            bind(both, lambda i: i / (F.size(a) + F.size(b) - i))
        )

    return bind(
        F.array_distinct(processed_tokens(left)),
        lambda a: bind(F.array_distinct(processed_tokens(right)), lambda b: ratio(a, b)),
    )


def text_runs(xml: Column, tag: str = "a:t", unescape: bool = False) -> Column:
    """Text between the opening and closing tag, stripped, joined with a space."""
    runs = F.regexp_extract_all(xml, F.lit(f"<{tag}[^>]*>([^<]+)</{tag}>"), F.lit(1))
    runs = F.filter(F.transform(runs, strip), lambda r: r != "")
    joined = F.array_join(runs, " ")
    if unescape:
        entities = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
        for entity, char in entities:
            joined = F.replace(joined, F.lit(entity), F.lit(char))
    return joined


def first_text(primary: Column, secondary: Column) -> Column:
    """The primary text, or the secondary one where the primary is null or empty."""
    return F.coalesce(F.nullif(primary, F.lit("")), secondary, F.lit(""))
