import hashlib
import itertools
import random
import re
import zlib

import pytest

from plotweave.llm import conversation_repair as c

SCHEMA = "conv_id long, turn long, role string, text string, audit string, key string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}


def by_enumeration(rows, most):
    """The best (cost, letters) of all edits with at most ``most`` inserts, straight from the grammar; rows are (initial, fault)."""
    best = None
    options = []
    for initial, fault in rows:
        mine = [("D", "", 4)]
        if fault in (c.NO_FAULT, c.CUT_OFF):
            extra = 3 * (fault == c.CUT_OFF)
            mine += [("K", "sua?"[initial], extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append(mine)
    inserts = [x for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*options):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, added)) > most:
                continue
            letters, roles, cost = "", "", 0
            for i, more in enumerate(added):
                letters, roles, cost = letters + "I" * len(more), roles + "".join(more), cost + 3 * len(more)
                if i < len(rows):
                    letters, roles, cost = letters + chosen[i][0], roles + chosen[i][1], cost + chosen[i][2]
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, letters) < best):
                best = cost, letters
    return best


def by_layers(rows):
    """(cost, letters) by relaxing all states row after row."""
    now = {0: (0, "")}

    def spread(labels):
        for _ in range(2):
            for state, (cost, letters) in list(labels.items()):
                to, new = (3 if state == 2 else 2), (cost + 3, letters + "I")
                labels[to] = min(labels.get(to, new), new)
        return labels

    for initial, fault in rows:
        then = {}
        for state, (cost, letters) in spread(now).items():
            ways = [(state, cost + 4, "D")]
            if fault in (c.NO_FAULT, c.CUT_OFF):
                extra = cost + 3 * (fault == c.CUT_OFF)
                ways.append((3 if state == 2 else 2, extra + 3, "R"))
                ways += [(to, extra, "K") for s, x, to in ((0, 0, 1), (0, 1, 2), (1, 1, 2), (2, 2, 3), (3, 1, 2)) if s == state and x == initial]
            for to, price, letter in ways:
                new = price, letters + letter
                then[to] = min(then.get(to, new), new)
        now = then
    return min(v for s, v in spread(now).items() if s in (0, 3))


def random_rows(rng, n):
    return [(rng.choice([0, 1, 1, 2, 2, 3]), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_against_enumeration():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        assert c.repair_one(rows) == by_enumeration(rows, 4)


def test_search_against_layers():
    rng = random.Random(2)
    for _ in range(400):
        rows = random_rows(rng, rng.randint(0, 40))
        assert c.repair_one(rows) == by_layers(rows)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_segments_combine_to_the_same(size):
    rng = random.Random(size)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(1, 40))
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        tables = []
        for n, part in enumerate(parts):
            ways = [c.search(part, start, n == len(parts) - 1, False) for start in range(c.STATES)]
            order = [sorted(x[1] for x in row if x) for row in ways]
            tables.append(([x[0] if x else -1 for row in ways for x in row], [o.index(x[1]) if x else -1 for row, o in zip(ways, order, strict=True) for x in row], [x for row in ways for x in row]))
        picks = c.combine((t[0], t[1]) for t in tables)
        chosen = [t[2][p] for t, p in zip(tables, picks, strict=True)]
        assert (sum(x[0] for x in chosen), "".join(x[1] for x in chosen)) == c.repair_one(rows)


def by_hand(turns):
    """The contract's columns for rows (conv, turn, role, text), by plain loops."""
    convs, out = {}, []
    for conv, turn, role, text in turns:
        convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\f\r")
            faults.append(c.BLANK if not end else c.DUPLICATE if (role, text) in seen else c.NO_FAULT if end[-1] in ".!?" else c.CUT_OFF)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in rows]
        codes = [("sua".find(i) if i and i in "sua" else 3, f) for i, f in zip(initials, faults, strict=True)]
        cost, audit = by_layers(codes)
        state, at, said = "", 0, []
        for letter in audit:
            role, text = ("assistant" if state == "u" else "user"), ""
            if letter != "I":
                role, text = (rows[at][1] if letter == "K" else role), rows[at][2]
                at += 1
            if letter != "D":
                state = role[:1]
                said.append(f"{role}:{text}")
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((str(conv), gaps, *(faults.count(f) for f in (c.BLANK, c.DUPLICATE, c.CUT_OFF)), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out)


def result(spark, turns):
    df = spark.createDataFrame([(*t, "clash", "clash") for t in turns], SCHEMA).repartition(5)
    return sorted((str(r[0]), *r[1:]) for r in c.repair_damaged(df).collect())


def random_turns(rng, convs, most):
    texts = ["Fine.", "no stop", "", " \t", "Yes!", "What?", "tail.  \n", None, "é ", "a.b.c", "  "]
    turns = []
    for conv in range(convs):
        for turn in range(rng.randint(0, most)):
            turns.append((conv, rng.choice([turn] * 9 + [None, turn + 5, 0]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(9)}."))
    return turns


def test_same_as_plain_loops(spark):
    rng = random.Random(11)
    turns = random_turns(rng, 70, 12) + [(None, t, "user", "lost.") for t in range(4)] + [(-7, None, "assistant", "x" * 200000)]
    assert result(spark, turns) == by_hand(turns)


def test_conversations_of_many_segments(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT_BITS", 2)
    rng = random.Random(12)
    turns = random_turns(rng, 6, 90) + random_turns(rng, 20, 6)
    assert result(spark, turns) == by_hand(turns)


def test_conversations_that_lose_all(spark):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    blank = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 1)
    found = {r[0]: r for r in result(spark, [(gone, 0, "user", "Hi."), (blank, 0, "user", "Hi.")])}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[str(gone)][1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert found[str(blank)][1:] == (0, 1, 0, 0, 0, 4, "D", nothing)


def test_rows_are_a_conversation(spark):
    rng = random.Random(5)
    turns = random_turns(rng, 25, 9)
    df = spark.createDataFrame([(*t, "", "") for t in turns], SCHEMA)
    repair = c.Repair(c.damage(df))
    rows = {}
    for r in repair.rows().collect():
        rows.setdefault(r.conv_id, []).append((r.pos, r.nth, r.role, r.text, r.edit))
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests().collect()}
    assert set(digests) == set(rows)
    for conv, mine in rows.items():
        mine.sort()
        assert GRAMMAR.fullmatch("".join(r[2][:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in mine).encode()).hexdigest() == digests[conv]
        assert all(r[3] == "" and r[2] in ROLES.values() for r in mine if r[4] == "I")


def test_empty(spark):
    assert c.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
