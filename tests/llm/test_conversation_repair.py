"""Repairs against a search over all lists of edits, and the query against a plain rendering of its rules."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from layerstack.llm import conversation_repair as cr

EMPTY = hashlib.sha256(b"").hexdigest()
SOLID = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each row (role, text) of a conversation in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and messages of the best edits: a search by cost, then audit, over all edits."""
    kinds = faults(rows)
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, out
        # Same rows read and same last role (or none): all that follows is the same.
        state = (at, initials[-1:])
        if state in done:
            continue
        done.add(state)
        fits = lambda x: re.match(r"s?(ua)*u?$", x)
        for role in ("user", "assistant"):
            if fits(initials + role[0]):
                heapq.heappush(queue, (cost + 2, audit + "I", at, initials + role[0], (*out, (role, ""))))
        if at == len(rows):
            continue
        role, text = rows[at]
        heapq.heappush(queue, (cost + 3, audit + "D", at + 1, initials, out))
        if kinds[at] in ("blank", "duplicate"):
            continue
        stay = int(kinds[at] == "truncated")
        if role and fits(initials + role[0]) and role[0] in "sua":
            heapq.heappush(queue, (cost + stay, audit + "K", at + 1, initials + role[0], (*out, (role, text))))
        for new in ("user", "assistant"):
            if fits(initials + new[0]):
                heapq.heappush(queue, (cost + 2 + stay, audit + "R", at + 1, initials + new[0], (*out, (new, text))))


def plain(conversations):
    """{conv: rows (turn, role, text)} to the summary, with nulls as one space."""
    out = {}
    for conv, rows in conversations.items():
        rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        pairs = [(r, x) for _, r, x in rows]
        kinds = faults(pairs)
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, messages = cheapest(pairs)
        text = "\n".join(f"{r}:{x}" for r, x in messages)
        out[conv] = (
            gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def grouped(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def random_rows(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["a.", "b!", "c ?\n", "open", "open \u0085", " \t", "", None, "é.", "　", "a."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    rows += rows[::17]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, monkeypatch, seed):
    rows = random_rows(seed)
    if seed == 2:
        rows += [(None, t, r, x) for _, t, r, x in rows[:9]]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id int, turn long, role string, text string, KEY int")
    assert result(cr.repair(df.repartition(3))) == plain(grouped(rows))


def test_spills(spark):
    """A conversation beyond what is held, over many batches, and its messages."""
    rows = [(5, i, ("user", "assistant")[i % 2] if i % 7 else "system", f"text {i}.") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = result(cr.repair(df))
        messages = cr.repaired(df).orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(grouped(rows))
    text = "\n".join(f"{m.role}:{m.text}" for m in messages)
    assert hashlib.sha256(text.encode()).hexdigest() == got[5][-1]
    assert [m.at for m in messages] == list(range(len(messages)))


def test_spool_is_bounded(monkeypatch):
    monkeypatch.setattr(cr, "HELD_BYTES", 100)
    rows = [(("user", "assistant")[i % 2], f"text {i}.") for i in range(50)]
    c = cr.Conversation("x")
    for i, (role, text) in reversed(list(enumerate(rows))):
        c.add(str(i), role, text, False, False, False)
    assert c.messages._rolled and c.choices._rolled
    assert c.summary()[1:] == plain({"x": [(i, *r) for i, r in enumerate(rows)]})["x"]
    c.close()


def test_all_short_conversations():
    """Every conversation of up to four rows over five kinds of row."""
    kinds = [("system", "s."), ("user", "u"), ("user", "v."), ("assistant", "a."), ("tool", "")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            c = cr.Conversation("x")
            for i in range(n - 1, -1, -1):
                kind = faults(rows[: i + 1])[-1]
                c.add(str(i), *rows[i], kind == "blank", kind == "duplicate", kind == "truncated")
            assert c.summary()[6:8] == cheapest(rows)[:2], rows


def test_edges(spark):
    schema = "conv_id string, turn long, role string, text string"
    assert cr.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", -(2**63), "user", "x."), ("a", 2**63 - 1, "assistant", "y."), ("", None, None, None), (None, 1, "user", "z")]
    got = result(cr.repair(spark.createDataFrame(rows, schema)))
    assert got["a"][0] == 2**63 - 1 and got["a"][5:7] == (0, "KK")
    assert got[""][:6] == (0, 1, 0, 0, 0, 3) and got[""][6] == "D" and got[""][7] == EMPTY
    assert got[None][6] == "D" and got[None][5] == 3


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage(spark):
    rows = random_rows(5) + [(None, None, "user", "x."), (7000, 3, "user", "y.")]
    rows += [(8000 + i, 0, "user", "all may go.") for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(cr.with_lost(df, cr.repair(cr.damaged(df))))
    want = plain(damage(rows))
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", EMPTY) for v in got.values())


def test_query(spark, llm):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = llm["op11_conversation_repair"](spark, sf)
    assert df.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ]
    got = result(df)
    assert got == plain(damage(rows))
    assert sum(v[1] for v in got.values()) and sum(v[2] for v in got.values()) and sum(v[3] for v in got.values())
