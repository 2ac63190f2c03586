"""Repair of the turn structure of conversations at least cost.

The roles of a conversation should read `(s?(ua)+)?`: at most one system turn, then user and
assistant in turn. A row is kept, gets the role that fits, or is deleted, and empty turns may be
put in; blank rows and repeats of an earlier row must go. In every state of that pattern only one
role can be put in or given, so the letters of the edits say the whole repair.

Costs to the end form one vector over the four states per row. They are computed backward, and
only the vectors at checkpoints, a square root of the rows apart, are kept; walking forward, each
block's vectors are computed again from its checkpoint, and of the edits that are tight the
ASCII-least letter is taken.

Rows are range-partitioned by conversation and turn, so a conversation of any length is cut into
runs, one per partition at most. Runs of one conversation are joined by their cost matrices
(state to state) and then by the states in which the repair leaves them; only conversations that
span partitions need that, at most two runs for each partition. Texts flow through sorted
partitions and are hashed as they pass.
"""

from pyspark.sql import Column, DataFrame, functions as F

from topicweir.runtime import Scratch

FAR = 1 << 60
# States: nothing yet, after system, after user, after assistant; each with its steps by initial.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FITS = "uuau"  # the one role that can be put in or given in each state
AT_END = (0, 4, 2, 0)  # cost of the turns to be put in after the last row
DELETE, INSERT, REROLE = 3, 2, 2
SPACE = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
GOOD_PAIRS = ("su", "ua", "au")
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
PIECE = 1 << 20  # characters of a run's repaired text held at a time

# A row's code is its role's initial, s, u or a (x for others), in upper case if the text is cut
# short, or d if it has to go.


def _before(code: str, after):
    """Costs to the end before a row, from those after it."""
    cost = [FAR] * 4
    cut = code.isupper()
    initial = code.lower()
    for q in (3, 2, 1, 0):
        best = after[q] + DELETE
        if code != "d":
            step = STEPS[q].get(initial)
            if step is not None:
                best = min(best, after[step] + cut)
            best = min(best, after[STEPS[q][FITS[q]]] + REROLE + cut)
        cost[q] = best
    # Turns put in before the row; two rounds reach every state from every other.
    for _ in range(3):
        for q in range(4):
            cost[q] = min(cost[q], cost[STEPS[q][FITS[q]]] + INSERT)
    return cost


def walk(codes: str, state: int = 0, after=AT_END, last: bool = True):
    """The ASCII-least cheapest edits of a run entered in `state`, and the state at its end.

    `after` are the costs from the end of the run. With `last`, turns may be put in at the end.
    """
    n = len(codes)
    block = max(1, int(n**0.5))
    checkpoints, vector = {n: list(after)}, list(after)
    for i in range(n - 1, -1, -1):
        vector = _before(codes[i], vector)
        if i % block == 0:
            checkpoints[i] = vector
    out = []
    for start in range(0, n, block):
        end = min(start + block, n)
        costs = [checkpoints[end]]
        for i in range(end - 1, start - 1, -1):
            costs.append(_before(codes[i], costs[-1]))
        costs.reverse()
        for i in range(start, end):
            now, then, code = costs[i - start], costs[i - start + 1], codes[i]
            cut, initial = code.isupper(), code.lower()
            while True:
                fit = STEPS[state][FITS[state]]
                if now[state] == then[state] + DELETE:
                    out.append("D")
                elif now[state] == now[fit] + INSERT:
                    out.append("I")
                    state = fit
                    continue
                elif code != "d" and initial in STEPS[state] and now[state] == then[STEPS[state][initial]] + cut:
                    out.append("K")
                    state = STEPS[state][initial]
                else:
                    out.append("R")
                    state = fit
                break
    if last:
        while AT_END[state]:
            out.append("I")
            state = STEPS[state][FITS[state]]
    return "".join(out), state


def matrix(codes: str):
    """Least cost of the run from each state at its begin to each at its end, row by row."""
    columns = []
    for end in range(4):
        vector = [FAR] * 4
        vector[end] = 0
        for code in reversed(codes):
            vector = [min(v, FAR) for v in _before(code, vector)]
        columns.append(vector)
    return [columns[end][begin] for begin in range(4) for end in range(4)]


def costs_at(codes: str, after=AT_END):
    vector = list(after)
    for code in reversed(codes):
        vector = _before(code, vector)
    return vector


def damage(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it
    the user's. conv_id and turn keep their nulls.
    """
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _run_key() -> Column:
    return F.shiftright("at", 33)


def _spelled(batches):
    """Runs -> their codes in a row, counts of faults, and initials at both ends."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for begin, initials, kept, places in zip(*(batch.column(c).to_pylist() for c in ("begin", "initials", "kept", "places"))):
            codes = ["d"] * len(initials)
            for at, code in zip(places, kept):
                codes[at - begin] = code
            pairs = map("".join, zip(initials, initials[1:]))
            illegal = sum(p not in GOOD_PAIRS for p in pairs)
            out.append(("".join(codes), len(initials) - len(kept), sum(map(str.isupper, kept)), illegal, initials[0], initials[-1]))
        names = ["codes", "gone", "truncated", "illegal", "head", "tail"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "run", "begin", "blank")), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["conv_id", "run", "begin", "blank", *names],
        )


def _fold(step: str):
    """Runs with their matrices, or with the states they lead to -> what each run needs from the others."""

    def ends(frame):
        vector = list(AT_END)
        for i in reversed(range(len(frame))):
            frame.at[i, "after"] = list(vector)
            row = frame.at[i, "matrix"]
            vector = [min(row[4 * q + r] + vector[r] for r in range(4)) for q in range(4)]
        return frame[["conv_id", "run", "after"]]

    def entries(frame):
        state = 0
        for i in range(len(frame)):
            frame.at[i, "state"] = state
            state = frame.at[i, "exits"][state]
        frame["last"] = frame.index == len(frame) - 1
        return frame[["conv_id", "run", "after", "state", "last"]]

    def run(frame):
        frame = frame.sort_values("run").reset_index(drop=True)
        if step == "ends":
            frame["after"] = None
            return ends(frame)
        frame["state"] = 0
        return entries(frame)

    return run


def _with_matrix(batches):
    import pyarrow as pa

    for batch in batches:
        found = [matrix(c) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("run"), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "run", "matrix"]
        )


def _with_exits(batches):
    import pyarrow as pa

    for batch in batches:
        exits = [[walk(c, q, a, False)[1] for q in range(4)] for c, a in zip(*(batch.column(x).to_pylist() for x in ("codes", "after")))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ("conv_id", "run", "after")), pa.array(exits, pa.list_(pa.int32()))],
            names=["conv_id", "run", "after", "exits"],
        )


def _with_edits(batches):
    """Runs -> their edits and costs; equal runs are repaired once a batch."""
    import pyarrow as pa

    for batch in batches:
        known, edits, costs = {}, [], []
        for codes, after, state, last in zip(*(batch.column(x).to_pylist() for x in ("codes", "after", "state", "last"))):
            key = codes, tuple(after), state, last
            if key not in known:
                known[key] = walk(codes, state, after, last)[0], costs_at(codes, after)[state]
            edits.append(known[key][0])
            costs.append(known[key][1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("run"), pa.array(edits, pa.string()), pa.array(costs, pa.int64()), batch.column("state"), batch.column("whole")],
            names=["conv_id", "run", "audit", "cost", "state", "whole"],
        )


def _repaired(batches):
    """Rows of runs in order, each run's edits first -> pieces of its repaired text.

    A conversation that is one run gives one row with the hash; a run of a longer one gives its
    text in pieces of about `PIECE` characters, each with the line break that follows a turn.
    """
    import hashlib

    import pyarrow as pa

    class Run:
        def __init__(self, conv, run, audit, state, whole):
            self.conv, self.run, self.audit, self.state, self.whole = conv, run, audit, state, whole
            self.next, self.held, self.size, self.piece, self.empty = 0, [], 0, 0, True
            self.hash = hashlib.sha256()

        def put(self, initial, role, text):
            self.state = STEPS[self.state][initial]
            if self.whole and not self.empty:
                self.hash.update(b"\n")
            self.empty = False
            if self.whole:
                self.hash.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                self.held.append(f"{role}:{text}")
                self.size += len(text)

        def inserted(self):
            while self.next < len(self.audit) and self.audit[self.next] == "I":
                self.put(FITS[self.state], ROLES[FITS[self.state]], "")
                self.next += 1

        def row(self, role, text):
            self.inserted()
            edit = self.audit[self.next]
            self.next += 1
            if edit == "K":
                self.put(role[0], role, text)
            elif edit == "R":
                self.put(FITS[self.state], ROLES[FITS[self.state]], text)

        def take(self):
            out = self.conv, self.run, self.piece, "\n".join(self.held), None
            self.held, self.size = [], 0
            self.piece += 1
            return out

        def close(self):
            self.inserted()
            if self.whole:
                return [(self.conv, self.run, 0, None, self.hash.hexdigest())]
            return [self.take()] if self.held else []

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["conv_id", "run", "piece", "text", "hash"]
        )

    current, rows = None, []
    for batch in batches:
        for conv, run, at, role, text, audit, state, whole in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None:
                if current:
                    rows += current.close()
                current = Run(conv, run, audit, state, whole)
            else:
                current.row(role, text)
                if current.size >= PIECE:
                    rows.append(current.take())
            if len(rows) >= 4096 or (rows and rows[-1][3]):
                yield batch_of(rows)
                rows = []
    if current:
        rows += current.close()
    if rows:
        yield batch_of(rows)


def _hashed(batches):
    """Pieces of conversations in order -> their hashes."""
    import hashlib

    import pyarrow as pa

    current, digest, rows = (), None, []
    for batch in batches:
        for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("text")):
            if (conv,) != current:
                if digest:
                    rows.append((current[0], digest.hexdigest()))
                current, digest = (conv,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.as_py().encode("utf-8", "surrogatepass"))
    if digest:
        rows.append((current[0], digest.hexdigest()))
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "hash"]
        )


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, of which conv_id may be null: nulls are one conversation."""
    renamed = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"other_{k}" for k in keys])


def _none(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)


def _ordered(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """All rows by conversation and turn; `at` numbers them, partition by partition."""
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    # `tie` tells equal rows apart, so that no value of the sort key is too large for a partition.
    numbered = scratch.table(own.withColumn("tie", F.monotonically_increasing_id()), "numbered")
    order = ["conv_id", "turn", "role", "digest", "tie"]
    first = F.substring("role", 1, 1)
    ordered = (
        numbered.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns(
            {
                "at": F.monotonically_increasing_id(),
                "blank": ~F.col("text").rlike(rf"[^{SPACE}]"),
                "cut": ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"),
                "initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"),
            }
        )
        .drop("tie")
    )
    ordered = scratch.table(ordered, "ordered")
    scratch.drop("numbered")
    return ordered


def _runs(scratch: Scratch, ordered: DataFrame) -> DataFrame:
    """The runs: rows of one conversation in one partition, as codes; their numbers are consecutive."""
    code = F.when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    # Of equal rows the first stays; rows without a code have to go.
    firsts = ordered.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"), F.any_value(code).alias("code"))
    parts = ordered.select("conv_id", "at", "initial", F.col("blank").cast("int").alias("blank"), _none("string", "code"))
    parts = parts.unionByName(firsts.select("conv_id", "at", _none("string", "initial"), F.lit(0).alias("blank"), "code"))

    def in_order(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("at", name))))

    listed = parts.groupBy("conv_id", _run_key().alias("run")).agg(
        F.min("at").alias("begin"), F.sum("blank").alias("blank"), in_order("initial").alias("rows"), in_order("code").alias("firsts")
    )
    listed = listed.select(
        "conv_id",
        "run",
        "begin",
        "blank",
        F.array_join("rows.initial", "").alias("initials"),
        F.array_join("firsts.code", "").alias("kept"),
        F.col("firsts.at").alias("places"),
    )
    schema = "conv_id long, run long, begin long, blank long, codes string, gone long, truncated long, illegal long, head string, tail string"
    return scratch.table(listed.mapInArrow(_spelled, schema), "runs")


def _entered(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """Of runs of conversations that span partitions: costs after them, state before them, last or not.

    A partition begins and ends in at most two such conversations, so there are no more than two
    such runs for each partition.
    """
    several = runs.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")
    spanning = scratch.table(_meet(runs.select("conv_id", "run", "codes"), several, ["conv_id"]), "spanning")
    vectors = spanning.mapInArrow(_with_matrix, "conv_id long, run long, matrix array<long>")
    vectors = vectors.groupBy("conv_id").applyInPandas(_fold("ends"), "conv_id long, run long, after array<long>")
    exits = _meet(spanning, vectors, ["conv_id", "run"]).select("conv_id", "run", "codes", "after")
    exits = exits.mapInArrow(_with_exits, "conv_id long, run long, after array<long>, exits array<int>")
    entered = exits.groupBy("conv_id").applyInPandas(_fold("entries"), "conv_id long, run long, after array<long>, state int, last boolean")
    return scratch.table(entered, "entered")


def _edits(scratch: Scratch, runs: DataFrame) -> DataFrame:
    """Runs with the letters of their edits; `cost` is that of the conversation from the run on."""
    alone = F.col("state").isNull()
    runs = _meet(runs.select("conv_id", "run", "codes"), _entered(scratch, runs), ["conv_id", "run"], "left").select(
        "conv_id",
        "run",
        "codes",
        F.coalesce("after", F.array(*[F.lit(v).cast("long") for v in AT_END])).alias("after"),
        F.coalesce("state", F.lit(0)).alias("state"),
        F.coalesce("last", F.lit(True)).alias("last"),
        alone.alias("whole"),
    )
    return scratch.table(runs.mapInArrow(_with_edits, "conv_id long, run long, audit string, cost long, state int, whole boolean"), "edits")


def _hashes(scratch: Scratch, ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, hash) of the repaired texts; conversations that span partitions pass as pieces."""
    heads = edits.select("conv_id", "run", _none("long", "at"), _none("string", "role"), _none("string", "text"), "audit", "state", "whole")
    body = ordered.select(
        "conv_id", _run_key().alias("run"), "at", "role", "text", _none("string", "audit"), _none("int", "state"), _none("boolean", "whole")
    )
    # The letters of a run come before its rows.
    flow = heads.unionByName(body).repartition("conv_id", "run").sortWithinPartitions("conv_id", "run", "at")
    pieces = scratch.table(flow.mapInArrow(_repaired, "conv_id long, run long, piece int, text string, hash string"), "pieces")
    parts = pieces.filter("hash IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "run", "piece").select("conv_id", "text")
    return pieces.filter("hash IS NOT NULL").select("conv_id", "hash").unionByName(parts.mapInArrow(_hashed, "conv_id long, hash string"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows`: its faults, cost and letters of the cheapest repair, hash of the result.

    `rows` needs conv_id, turn (whole numbers), role and text; other columns are ignored. Nulls in
    role and text count as one space; rows without conv_id are one conversation with a null id.
    Rows go by turn, those without turn first; rows of one turn go by role, then by the SHA-256 of
    their text. A role that is empty or begins with other letters than s, u and a fits nowhere.
    `gaps` is null where the turns span more than a long holds. An empty table gives an empty
    result.

    Letters: D delete, I put in an empty turn, K keep, R give the fitting role.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    ordered = _ordered(scratch, rows)
    runs = _runs(scratch, ordered)
    edits = _edits(scratch, runs)
    hashes = _hashes(scratch, ordered, edits)

    turns = ordered.select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = F.expr("try_add(try_subtract(max(turn), min(turn)), 1 - count(turn))")
    turns = turns.agg(F.when(F.count("turn") == 0, 0).otherwise(gaps).alias("gaps"))
    edges = F.array_sort(F.collect_list(F.struct("run", "head", "tail")))
    faults = runs.groupBy("conv_id").agg(
        F.sum("blank").alias("blank"),
        (F.sum("gone") - F.sum("blank")).alias("duplicate"),
        F.sum("truncated").alias("truncated"),
        F.sum("illegal").alias("within"),
        edges.alias("edges"),
    )
    # Where one run ends and the next begins.
    pairs = F.zip_with(F.expr("slice(edges, 1, size(edges) - 1)"), F.expr("slice(edges, 2, size(edges))"), lambda a, b: F.concat(a["tail"], b["head"]))
    bad = F.size(F.filter(pairs, lambda p: ~p.isin(*GOOD_PAIRS)))
    faults = faults.withColumn("illegal", F.col("within") + bad)
    audits = edits.groupBy("conv_id").agg(F.min_by("cost", "run").alias("cost"), F.array_sort(F.collect_list(F.struct("run", "audit"))).alias("parts"))
    out = _meet(_meet(turns, faults, ["conv_id"]), audits, ["conv_id"])
    return _meet(out, hashes, ["conv_id"], "left").select(
        "conv_id",
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        "cost",
        F.array_join("parts.audit", "").alias("audit"),
        F.coalesce("hash", F.lit(EMPTY_HASH)).alias("repaired_sha256"),
    )


def repair_report(rows: DataFrame) -> DataFrame:
    """`rows` damaged, then repaired; conversations of which no row is left have zeros and an empty text."""
    found = repair_conversations(damage(rows)).withColumn("left", F.lit(True))
    everyone = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    gone = F.col("left").isNull()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _meet(everyone, found, ["conv_id"], "left").select(
        "conv_id",
        *[F.when(gone, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in numbers],
        F.when(gone, "").otherwise(F.col("audit")).alias("audit"),
        F.when(gone, EMPTY_HASH).otherwise(F.col("repaired_sha256")).alias("repaired_sha256"),
    )
