"""How many dictionary entries of each subject occur in a text (substring, not word).

The entries become one pattern, a tree of their common beginnings, that is tried at every place
of the text and takes the longest entry there; entries that begin another one go with it. So all
entries are found in one pass in the JVM, and the work per text hardly depends on their number.
Where a caller allows it, a few entries are sought one by one instead, which costs less than the
pattern up to about a hundred.
"""

import re
import zlib
from collections import Counter

from pyspark.sql import Column, functions as F

from topicweir.runtime import bind, json_constant
from topicweir.sources.dictionary import KeywordDictionary

FEW = 64  # entries that are sought one by one
WIDE = 6  # branches of the tree that are tried one after another; more are parted by ranges first


def choice(patterns: list[str], heads: list[str]) -> str:
    if len(patterns) <= WIDE:
        return "|".join(patterns)
    middle = len(patterns) // 2
    sides = [(patterns[:middle], heads[:middle]), (patterns[middle:], heads[middle:])]
    return "|".join(f"(?=[\\x{{{ord(h[0]):x}}}-\\x{{{ord(h[-1]):x}}}])(?:{choice(p, h)})" for p, h in sides)


def prefix_pattern(entries: list[str]) -> str:
    """A pattern for the longest of `entries` (none empty) at a place, without backtracking over branches."""

    def tree(words: list[str]) -> str:
        """`words` sorted and distinct; an empty one means that the pattern may end here."""
        ends = bool(words) and words[0] == ""
        words = words[1:] if ends else words
        if not words:
            return ""
        branches, begin = [], 0
        for i in range(1, len(words) + 1):
            if i == len(words) or words[i][0] != words[begin][0]:
                branches.append(words[begin:i])
                begin = i
        body = choice(list(map(branch, branches)), [b[0][0] for b in branches])
        return f"(?:{body})?" if ends else body if len(branches) == 1 else f"(?:{body})"

    def branch(words: list[str]) -> str:
        first, last = words[0], words[-1]
        same = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
        return re.escape(first[:same]) + tree([w[same:] for w in words])

    return tree(sorted(set(entries)))


class EntryMatcher:
    """Distinct entries of a dictionary, with their number per subject."""

    def __init__(self, dictionary: KeywordDictionary):
        self.width = len(dictionary.entries)
        self.owners: dict[str, Counter] = {}
        for i, (_, kws) in enumerate(dictionary.entries):
            for kw in kws:
                self.owners.setdefault(kw, Counter())[i] += 1
        self.always = self.owners.pop("", Counter())
        self.entries = sorted(self.owners)

    def found(self, low: Column) -> Column:
        """Numbers of the entries that the text contains, each once."""
        number = {e: i for i, e in enumerate(self.entries)}
        size = 1 << max(4, (2 * len(self.entries)).bit_length())
        table: list[list] = [[] for _ in range(size)]
        for e in self.entries:
            begins = [number[e[:n]] for n in range(1, len(e) + 1) if e[:n] in number]
            table[zlib.crc32(e.encode()) % size].append({"e": e, "ids": begins})
        constant = json_constant(table, "array<array<struct<e: string, ids: array<int>>>>")

        def ids(longest: Column) -> Column:
            bucket = F.get(constant, F.pmod(F.crc32(longest.cast("binary")), F.lit(size)).cast("int"))
            return F.flatten(F.transform(F.filter(bucket, lambda b: b["e"] == longest), lambda b: b["ids"]))

        places = F.regexp_extract_all(low, F.lit(f"(?=({prefix_pattern(self.entries)}))"), F.lit(1))
        return F.array_distinct(F.flatten(F.transform(F.array_distinct(places), ids)))

    def counts(self, low: Column) -> Column:
        """One count per subject; the empty entry is in every text."""
        always = F.array(*[F.lit(self.always[i]) for i in range(self.width)])
        if not self.entries:
            return always
        weights = json_constant([[self.owners[e][i] for e in self.entries] for i in range(self.width)], "array<array<int>>")
        return bind(
            self.found(low),
            lambda found: F.transform(
                always, lambda n, i: bind(F.get(weights, i), lambda own: F.aggregate(found, n, lambda a, e: a + F.get(own, e)))
            ),
        )

    def counts_one_by_one(self, low: Column) -> Column:
        """The same without a pattern; the work per text grows with the number of entries."""

        def of(subject: int) -> Column:
            own = [(e, n[subject]) for e, n in self.owners.items() if subject in n]
            return sum((F.when(F.contains(low, F.lit(e)), n).otherwise(0) for e, n in own), F.lit(self.always[subject]))

        return F.array(*[of(i) for i in range(self.width)])


def keyword_counts(low: Column, dictionary: KeywordDictionary, few: int = 0) -> Column:
    """Array with one count per subject; `low` is the lower-cased text, never null.

    Up to `few` entries are sought one by one.
    """
    matcher = EntryMatcher(dictionary)
    return bind(low, matcher.counts_one_by_one) if len(matcher.entries) <= few else matcher.counts(low)


def own_class_count(low: Column, label: Column, dictionary: KeywordDictionary) -> Column:
    """Count for the row's own subject only; 0 for a label the dictionary lacks."""
    position = F.array_position(F.array(*[F.lit(s) for s in dictionary.subjects]), label)
    return F.coalesce(F.get(keyword_counts(low, dictionary), (position - 1).cast("int")), F.lit(0))
