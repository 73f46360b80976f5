import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import dialogue
from tidemark.llm.dialogue import END, _open, costs, op12_conversation_repair, repair, repair_conversations, walk

SPACE = "\x20\t\n\x0b\x0c\r"
SMALL = "/root/testdata/sf0.001"


def search(rows):
    """Cheapest, then ASCII-least edits by a search over all of them; rows of (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if (i, initials, audit) in seen:
            continue
        seen.add((i, initials, audit))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(out)

        def push(extra, letter, step, role=None, text=None):
            after = initials if role is None else initials + (role[:1] or "-")
            if re.fullmatch("s?(ua)*u?", after):
                heapq.heappush(heap, (cost + extra, audit + letter, i + step, after, out if role is None else (*out, f"{role}:{text}")))

        if len(initials) < 2 * len(rows) + 2:
            push(2, "I", 0, "user", "")
            push(2, "I", 0, "assistant", "")
        if i < len(rows):
            role, text, fault = rows[i]
            push(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                push(late, "K", 1, role, text)
                push(2 + late, "R", 1, "user", text)
                push(2 + late, "R", 1, "assistant", text)


def plain(rows, find=search):
    """Result of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = find([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def table(rows):
    """Least (cost, audit) by a table over places and states, for longer conversations."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        now = {q: (0, "", ()) for q in ("", "a")} if i == len(rows) else {}
        if i < len(rows):
            role, text, fault = rows[i]
            for q in after:
                options = []
                if q in best[i + 1]:
                    c, a, o = best[i + 1][q]
                    options.append((c + 3, "D" + a, (None, o)))
                if fault not in ("blank", "duplicate"):
                    for cost, letter, name in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                        to = after[q].get(name[:1])
                        if to in best[i + 1]:
                            c, a, o = best[i + 1][to]
                            options.append((c + cost + (fault == "truncated"), letter + a, (f"{name}:{text}", o)))
                now[q] = min(options, key=lambda x: x[:2]) if options else (1 << 50, "", ())
        for _ in range(3):
            for q in after:
                for name in ("user", "assistant"):
                    to = after[q].get(name[:1])
                    if to in now:
                        c, a, o = now[to]
                        if q not in now or (c + 2, "I" + a) < now[q][:2]:
                            now[q] = (c + 2, "I" + a, (f"{name}:", o))
        best[i] = now
    cost, audit, chain = best[0][""]
    out = []
    while chain:
        if chain[0] is not None:
            out.append(chain[0])
        chain = chain[1]
    return cost, audit, out


def damage(rows):
    out = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fate == 0:
            continue
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out += [(c, t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    return out


def by_conversation(rows, names, find):
    return {c: plain([r[1:] for r in rows if r[0] == c], find) for c in names}


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def some_rows(r, conv, n):
    texts = ["Hi.", "Well", "What?", "", " \t", "No!", " so. ", "\x0bé.", "日本", None, "Hi.", "..."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "sys"]
    turns = sorted((r.choice([None, *range(12)]) for _ in range(n)), key=lambda t: (t is not None, t or 0))
    return [(conv, t, r.choice(roles), r.choice(texts)) for t in turns]


def test_codes_against_search():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "tool"]), "x", r.choice(["", "", "truncated", "blank"])) for _ in range(r.randint(0, 6))]
        codes = bytes(dialogue._GONE if f == "blank" else dialogue.code(role[:1], f == "truncated") for role, _, f in rows)
        cost, audit, out = search(rows)
        assert repair(codes) == (cost, audit) == table(rows)[:2]
        assert dialogue.repaired(audit, [x[:2] for x in rows]) == out == table(rows)[2]


def test_segments_give_the_walk_of_the_whole():
    r = random.Random(2)
    for _ in range(200):
        codes = bytes(r.randrange(9) for _ in range(r.randint(0, 40)))
        cuts = sorted(r.randint(0, len(codes)) for _ in range(3))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        rest = [_open(list(END))]
        for part in reversed(parts):
            m = dialogue.transfer(part)
            rest.append(tuple(min(m[4 * q + e] + rest[-1][e] for e in range(4)) for q in range(4)))
            assert rest[-1] == costs(part, rest[-2])
        rest.reverse()
        state, audit = 0, ""
        for i, part in enumerate(parts):
            more, state = walk(part, rest[i + 1], state, i == len(parts) - 1)
            audit += more
        assert (rest[0][0], audit) == repair(codes)


@pytest.mark.parametrize("rows, size", [(1 << 15, 1 << 20), (3, 1 << 20), (1 << 15, 20)])
def test_against_plain_version(spark, monkeypatch, rows, size):
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(dialogue, "SEGMENT_BYTES", size)
    r = random.Random(7)
    data = [x for c in range(60) for x in some_rows(r, c, r.randint(1, 7))] + some_rows(r, None, 5) + some_rows(r, 1000, 120)
    frame = spark.createDataFrame([(*x, 5, "b") for x in data], "conv_id long, turn long, role string, text string, cost int, conv string").repartition(3)
    names = {x[0] for x in data}
    assert result(repair_conversations(frame)) == by_conversation(data, names, table)
    damaged = dialogue.damaged(frame)
    assert result(repair_conversations(damaged, copies="copies")) == by_conversation(damage(data), names, table)


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SEGMENT_ROWS", 50)
    r = random.Random(9)
    data = [("hot", i // 2, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", f"T{i}.", f"T{i % 300}!", ""])) for i in range(2000)]
    data += [(f"c{i}", 0, "user", "Hi.") for i in range(30)]
    frame = spark.createDataFrame(data, "conv_id string, turn long, role string, text string").repartition(4)
    got = result(repair_conversations(frame))
    hot = [x[1:] for x in data if x[0] == "hot"]
    assert got["hot"] == plain(hot, table)
    assert got["c3"] == plain([(0, "user", "Hi.")])


def test_very_long_text_empty_table_and_nothing_left(spark):
    kind = "conv_id long, turn long, role string, text string"
    long = "x" * 3_000_000
    data = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, None, None, None), (2, None, None, None)]
    assert result(repair_conversations(spark.createDataFrame(data, kind))) == by_conversation(data, {1, 2}, table)
    assert result(repair_conversations(spark.createDataFrame([], kind))) == {}
    gone = spark.createDataFrame([(5, 1, "user", "a.", 0), (5, 2, "user", "b.", 0)], kind + ", n int")
    assert result(repair_conversations(gone, copies="n")) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_conversation_repair(spark, SMALL)) == by_conversation(damage(rows), {r[0] for r in rows}, table)
