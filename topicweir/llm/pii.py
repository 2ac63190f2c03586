"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Fixed patterns give the base spans of four kinds; they always stay. High-recall generators
propose further, overlapping spans: cards and numbers inside longer runs of digits, phone numbers
without a plus sign or run together with what follows, addresses written with "at" and "dot".
Boosted trees are fitted on the candidates whose label is known: those that are a base span,
against those that a pattern proposes and a rule rejects. They see the format and the context of
a candidate; a threshold calibrated on the held-out half of all known candidates selects further
spans, the best ones first and none that overlaps another span of its kind.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from topicweir.runtime import Scratch

KINDS = ["email", "ip", "card", "phone"]

# The patterns of the four kinds. Possessive and anchored at the start of a run, they match what
# the plain patterns match, in time linear in the text:
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap sign that a kind may be in a text.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){11}", "phone": r"\+[0-9]"}

# High-recall generators, with the kind that each proposes.
PROPOSALS = [
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){1,5}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
]
PROPOSAL_GATES = [
    r"[0-9](?:[\x20-]?+[0-9]){14}", r"[0-9](?:[\x20-]?+[0-9]){14}", r"\+[0-9]", r"[0-9]{3}[\x20.-][0-9]{4}", r"[(\[]at[)\]]", r"[0-9]\.[0-9]",
]

CONTEXT = 24
MIN_PRECISION = 0.98
TREES = 8
DEPTH = 4

_SPAN = "array<struct<kind: string, start: int, end: int, hit: string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda d, i: F.when((i % 2 == 1) & (d > 4), 2 * d - 9).when(i % 2 == 1, 2 * d).otherwise(d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.expr("0") + F.ascii(c) - 48, i))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, hit: Column) -> Column:
    """The rule of each kind for a match of its base pattern."""
    n = F.length(_digits(hit))
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "ip", hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", n.between(12, 19) & luhn(F.substring(_digits(hit), 1, 19)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _found(kind: str, parts: str, hits: str) -> Column:
    """Spans from the pieces between matches and the matches: code points, end exclusive.

    The starts are summed up in one pass, as text, since an array would be copied for each match.
    """
    return F.expr(
        f"""coalesce(transform(array(split(substr(aggregate(arrays_zip({parts}, {hits}),
            named_struct('at', 0, 'out', ''),
            (a, x) -> named_struct(
                'at', a.at + char_length(x.{parts}) + coalesce(char_length(x.{hits}), 0),
                'out', CASE WHEN x.{hits} IS NULL THEN a.out ELSE concat(a.out, ',', a.at + char_length(x.{parts})) END),
            a -> a.out), 2), ',')),
            s -> transform({hits}, (h, i) -> named_struct(
                'kind', '{kind}', 'start', int(get(s, i)), 'end', int(get(s, i)) + char_length(h), 'hit', h)))[0],
            cast(array() AS {_SPAN}))"""
    )


def _spans(rows: DataFrame) -> DataFrame:
    """`rows` with `base` (valid base spans), `failed` (base matches that a rule rejects) and `proposed`."""
    sources = [(k, BASE[k], GATES[k]) for k in KINDS] + [(k, p, g) for (k, p), g in zip(PROPOSALS, PROPOSAL_GATES)]
    cut = {}
    for i, (_, pattern, gate) in enumerate(sources):
        on = F.col("text").rlike(gate)
        cut[f"parts{i}"] = F.when(on, F.split("text", pattern, -1))
        cut[f"hits{i}"] = F.when(on, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = {f"found{i}": _found(k, f"parts{i}", f"hits{i}") for i, (k, _, _) in enumerate(sources)}
    keep = [c for c in rows.columns]
    rows = rows.withColumns(cut).select(*keep, *[c.alias(n) for n, c in found.items()])
    matches = F.concat(*[f"found{i}" for i in range(len(KINDS))])
    proposed = F.concat(*[f"found{i}" for i in range(len(KINDS), len(sources))])
    return rows.select(*keep, matches.alias("matches"), proposed.alias("proposed")).select(
        *keep,
        F.filter("matches", lambda s: valid(s["kind"], s["hit"])).alias("base"),
        F.filter("matches", lambda s: ~valid(s["kind"], s["hit"])).alias("failed"),
        "proposed",
    )


def _described(rows: DataFrame) -> DataFrame:
    """Every candidate once, with its context cut out of the text and what is known of it."""
    tag = lambda name, origin: F.transform(
        name,
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(origin).alias("origin"),
            F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))).alias("before"),
            F.substring(F.col("text"), s["end"] + 1, F.lit(8)).alias("after"),
        ),
    )
    every = F.concat(tag("base", 0), tag("failed", 1), tag("proposed", 2))
    return rows.withColumn("candidates", every)


FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "size", "digits", "groups", "longest_group", "other", "luhn_ok", "octets_ok",
    "plus", "parens", "glued_before", "glued_after", "hint", "against",
]


def _features(c: DataFrame) -> DataFrame:
    hit, kind = F.col("hit"), F.col("kind")
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    hints = r"(?i)(?:tel|phone|call|fax|mobil|móvil|card|carte|karte|tarjeta|visa|mail|contact|\bip\b|host|server)[^A-Za-z]*$"
    against = r"(?i)(?:[$€£#=]|\bno\.?|\bid|isbn|token|key|sha|order|version|v)[^A-Za-z0-9]*$"
    return c.withColumns(
        {f"is_{k}": flag(kind == k) for k in KINDS}
        | {
            "size": F.length(hit).cast("double"),
            "digits": F.length(_digits(hit)).cast("double"),
            "groups": F.size(groups).cast("double"),
            "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
            "other": F.length(F.regexp_replace(hit, r"[0-9\x20().+-]", "")).cast("double"),
            "luhn_ok": flag(luhn(F.substring(_digits(hit), 1, 19)) & F.length(_digits(hit)).between(12, 19)),
            "octets_ok": flag(valid(F.lit("ip"), hit)),
            "plus": flag(hit.startswith("+")),
            "parens": flag(hit.contains("(")),
            "glued_before": flag(F.col("before").rlike(r"[A-Za-z0-9._%+-]$")),
            "glued_after": flag(F.col("after").rlike(r"^(?:[A-Za-z0-9]|[.-][0-9])")),
            "hint": flag(F.col("before").rlike(hints)),
            "against": flag(F.col("before").rlike(against)),
        }
    )


def _model(known: DataFrame):
    """Boosted trees and the least score at which the held-out half is right often enough, or None.

    A row of `known` stands for `n` candidates.
    """
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 20:
        return None
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="n").fit(assembled.filter("NOT held_out"))
    scored = model.transform(assembled.filter("held_out")).select(
        "n", (F.col("n") * F.col("label")).alias("good"), F.round(vector_to_array("probability")[1], 2).alias("score")
    )
    # Scores are rounded to hundredths, so this is at most 101 rows.
    steps = sorted(
        ((r.score, r.n, r.good) for r in scored.groupBy("score").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()),
        reverse=True,
    )
    least, n, good = None, 0, 0.0
    for score, more, right in steps:
        n, good = n + more, good + right
        if good < MIN_PRECISION * n:
            break
        least = score
    return None if least is None else (model, max(0.5, least))


def find_pii(docs: DataFrame) -> DataFrame:
    """`doc_id`, `base` and `spans` (arrays of kind, start, end, sorted by start and kind) of every row.

    `docs` needs `doc_id` and `text`; other columns are ignored. Null texts are empty. Every input row
    gives one row, also when rows or ids repeat. An empty table gives an empty result. Where the
    table has too few known candidates to fit trees, proposals are taken by rule: those that pass
    their kind's check, stand apart from letters and digits, and are not named as something else.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _described(_spans(rows)).select("doc_id", F.monotonically_increasing_id().alias("row"), "base", "candidates")
    found = scratch.table(found, "found")
    each = found.select("row", F.posexplode("candidates").alias("n", "c")).select("row", "n", "c.*")
    each = scratch.table(_features(each), "each")

    # Known candidates: base spans, and matches or proposals of a checked kind that the rule rejects.
    known = each.withColumn(
        "label",
        F.when(F.col("origin") == 0, 1.0).when((F.col("origin") == 1) | ~valid(F.col("kind"), F.col("hit")), 0.0),
    ).filter("label IS NOT NULL")
    # Trees see the features alone, so candidates alike in them are one row with their number as weight.
    known = known.groupBy(*FEATURES, "label", (F.pmod(F.xxhash64("hit"), F.lit(2)) == 1).alias("held_out")).agg(F.count("*").alias("n"))
    fitted = _model(scratch.table(known, "known"))

    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)])
    plain = "array<struct<kind: string, start: int, end: int>>"
    ordered = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    open_ones = each.filter("origin = 2")
    if fitted is None:
        # Too few known candidates to learn from: what stands alone and is not called something else.
        apart = (F.col("glued_before") == 0) & (F.col("glued_after") == 0) & (F.col("against") == 0)
        least, scored = 0.5, open_ones.withColumn("score", F.when(apart, 1.0).otherwise(0.0))
    else:
        model, least = fitted
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(open_ones))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
    picked = (
        scored.filter((F.col("score") >= least) & valid(F.col("kind"), F.col("hit")))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("cost"), "start", "kind", "end"))).alias("picked"))
    )
    joined = found.select("row", "doc_id", "base").join(picked, "row", "left")
    grown = F.expr(
        f"""aggregate(coalesce(picked, array()),
            transform(base, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)),
            (a, c) -> CASE WHEN exists(a, s -> s.kind = c.kind AND s.start < c.end AND c.start < s.end) THEN a
                ELSE concat(a, array(named_struct('kind', c.kind, 'start', c.start, 'end', c.end))) END)"""
    )
    return joined.select("doc_id", ordered("base").cast(plain).alias("base"), ordered(grown).cast(plain).alias("spans"))


def pii_report(found: DataFrame) -> DataFrame:
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
