import hashlib
import heapq
import random
import re
import zlib

from topicweir.llm.conversation_repair import AT_END, costs_at, damage, matrix, repair_conversations, repair_report, walk

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows, faults):
    """Least cost and ASCII-least letters over all edit sequences, by a search that knows no states."""
    limit = 3 * len(rows) + 5
    heap = [(0, "", 0, ())]
    seen = {}
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        roles = "".join(r[:1] or "?" for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        key = i, roles[-1:], len(roles) > 0
        if cost > limit or not re.fullmatch("s?(ua)*u?", roles) or seen.setdefault(key, (cost, audit)) != (cost, audit):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, out + ((role, ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, out + ((new, text),)))
    raise AssertionError


def brute(rows):
    """rows: (conv_id, turn, role, text) -> the result's rows."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[:1] or "?" for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest([(r, t) for _, r, t in own], faults)
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def made(rng, n):
    texts = ["Yes.", "No!", "So?\n", "cut", "cut off ", "", " \t", "Ünd. ", "Ends. \x0b"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", "User", None]
    return [(rng.choice([1, 2, 2, 3, 4, 5, None, 7]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice([*texts, None, f"t{rng.randrange(9)}."])) for _ in range(n)]


def frame(spark, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, run int, audit string, at string"
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], schema).repartition(parts)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_repairs_against_search(spark):
    rng = random.Random(4)
    rows = made(rng, 30)
    for conv in range(100, 160):
        turns = rng.sample(range(12), rng.randrange(1, 7))
        rows += [(conv, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B!", "c", " "]) if rng.random() < 0.5 else f"{t}?") for t in turns]
    assert got(repair_conversations(frame(spark, rows))) == brute(rows)


def test_damage_and_lost_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}. Done.") for c in range(250) for t in range(rng.choice([1, 1, 2, 3, 4, 5]))]
    rows += [(None, t, None, "x.") for t in range(3)] + [(8, None, "assistant", None)]
    df = frame(spark, rows)
    assert sorted(map(tuple, damage(df).collect()), key=str) == sorted(planted(rows), key=str)
    result = got(repair_report(df))
    left = {r[0]: r for r in brute(planted(rows))}
    empty = hashlib.sha256(b"").hexdigest()
    assert result == sorted((left.get(c, (c, 0, 0, 0, 0, 0, 0, "", empty)) for c in {r[0] for r in rows}), key=str)
    assert any(r[7] == "" for r in result)


def test_long_conversation_over_many_partitions(spark):
    """One conversation that holds most rows, many of them equal, is cut into runs and joined again."""
    rng = random.Random(2)
    rows = [(5, t // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Same.", f"{t}.", f"{t}", ""])) for t in range(3000)]
    rows += [(5, 700, "user", "Equal.")] * 800 + [(4, 1, "user", "Hi."), (6, 1, "assistant", "Ho.")]
    result = {r[0]: r for r in got(repair_conversations(frame(spark, rows, 6)))}
    own = sorted((r for r in rows if r[0] == 5), key=lambda x: (x[1], x[2], hashlib.sha256(x[3].encode()).hexdigest()))
    seen, codes = set(), []
    for _, _, role, text in own:
        initial = role[0] if role[0] in "sua" else "x"
        codes.append("d" if not text or (role, text) in seen else initial if text.endswith(".") else initial.upper())
        seen.add((role, text))
    audit, _ = walk("".join(codes))
    assert result[5][6:8] == (costs_at("".join(codes))[0], audit)
    state, text, rest = 0, [], iter(own)
    for edit in audit:
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        row = next(rest) if edit != "I" else None
        if edit == "K":
            role = row[2]
        if edit != "D":
            text.append(f"{role}:{row[3] if row else ''}")
            state = {"system": 1, "user": 2, "assistant": 3}[role]
    assert result[5][8] == hashlib.sha256("\n".join(text).encode()).hexdigest()
    initials = [r[2][0] for r in own]
    assert result[5][5] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert result[4][7] == "KI" and result[6][7] == "IK"


def test_runs_join_like_one(spark):
    rng = random.Random(7)
    for _ in range(60):
        codes = "".join(rng.choices("suaSUAdx", k=rng.randrange(1, 60)))
        cut = rng.randrange(len(codes) + 1)
        audit, state = walk(codes)
        after = costs_at(codes[cut:])
        m = matrix(codes[:cut])
        assert min(m[r] + after[r] for r in range(4)) == costs_at(codes)[0]
        head, middle = walk(codes[:cut], 0, after, False)
        tail, end = walk(codes[cut:], middle)
        assert (head + tail, end) == (audit, state)
        assert AT_END[end] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert got(repair_conversations(df)) == [] and got(repair_report(df)) == []


def test_wide_turns(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(1, low, "user", "A."), (1, high, "assistant", "B."), (2, None, "user", "A."), (2, None, "assistant", "B.")]
    result = {r[0]: r for r in got(repair_conversations(frame(spark, rows)))}
    assert result[1][1] is None and result[2][1] == 0
    assert [result[2]] == brute(rows[2:])
