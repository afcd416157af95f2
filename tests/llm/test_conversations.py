import hashlib
import itertools
import random
import re
import zlib

import pytest

from cadenza.llm import conversations as c

ROLES = ["user", "assistant", "system", "tool", "", "unheard"]
SCHEMA = "conv_id long, turn long, role string, text string, letters string, at string, h1 string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(x for x in text if x not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(c.SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Row by row: the best (cost, edits, repaired) of each state."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def insert(best):
        for _ in range(2):
            for state, (cost, edits, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    offer(best, step.get((role[0], state)), (cost + 5, edits + "I", [*lines, f"{role}:"]))

    def offer(best, state, entry):
        if state is not None and (state not in best or entry[:2] < best[state][:2]):
            best[state] = entry

    best = {0: (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults(rows)):
        insert(best)
        after = {}
        for state, (cost, edits, lines) in best.items():
            offer(after, state, (cost + 2, edits + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 5 * (fault == "truncated")
            offer(after, step.get((role[:1], state)), (more, edits + "K", [*lines, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                offer(after, step.get((new[0], state)), (more + 1, edits + "R", [*lines, f"{new}:{text}"]))
        best = after
    insert(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda e: e[:2])


def plain_report(rows):
    """Rows are in order."""
    kinds = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    roles = [r[2][:1] for r in rows]
    cost, audit, lines = plain_repair(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in c.KINDS[:3]],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest())


def enumerated(roles: str, kinds: list[str]):
    """The best of all edits, by trying them all with up to two inserts anywhere."""
    options = []
    for role, kind in zip(roles, kinds):
        extra = 5 * (kind == "truncated")
        options.append([(2, "D", "")] + ([] if kind in ("blank", "duplicate") else [
            (extra, "K", role), (1 + extra, "R", "u"), (1 + extra, "R", "a")]))
    inserts = [[(5 * n, "I" * n, "".join(r)) for n in range(3) for r in itertools.product("ua", repeat=n)]] * (len(roles) + 1)
    steps = [x for pair in itertools.zip_longest(inserts, options) for x in pair if x is not None]
    best = None
    for choice in itertools.product(*steps):
        if re.fullmatch(r"(s?(ua)+)?", "".join(x[2] for x in choice)):
            entry = sum(x[0] for x in choice), "".join(x[1] for x in choice)
            best = entry if best is None else min(best, entry)
    return best


def test_the_plain_version_against_all_edits():
    rnd = random.Random(1)
    for _ in range(150):
        n = rnd.randrange(4)
        rows = [(1, i, rnd.choice(ROLES), rnd.choice(["", f"open {i}", f"end {i}.", f"end {i}."])) for i in range(n)]
        initials = "".join(r[2][:1] or "?" for r in rows)
        assert plain_repair(rows)[:2] == enumerated(initials, faults(rows))


def test_matrices_of_shared_rules():
    rnd = random.Random(2)
    strings = ["".join(rnd.choice("mnopijk" if i % 3 else "no") for _ in range(rnd.randrange(60))) for i in range(80)]
    for string, matrix in zip(strings, c.matrices(strings)):
        rows = []
        for i, x in enumerate(string):
            kind, role = c.KINDS[(ord(x) - 97) // 4], ["system", "user", "assistant", "tool"][(ord(x) - 97) % 4]
            rows.append((1, i, role, f"{i}." if kind == "fine" else f"{i}"))
        assert c.closing(matrix[0]) == plain_repair(rows)[:2]


def test_rules_spell_the_strings():
    strings = ["no" * 30, "nnnnnnn", "", "mno", "pnono" * 5]
    rules, symbols = c.repair_grammar(strings)

    def spelled(symbol):
        return chr(97 + symbol) if symbol < 16 else spelled(rules[symbol - 16][0]) + spelled(rules[symbol - 16][1])
    assert rules and ["".join(map(spelled, s)) for s in symbols] == strings


def conversations(seed: int):
    rnd = random.Random(seed)
    out = []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 9)):
            text = rnd.choice([f"text {conv} {turn}.", f"cut {turn}", "same!", " \n", "", "done? ", "é." * rnd.randrange(1, 4)])
            out.append((conv, turn * rnd.choice([1, 1, 2]), rnd.choice(ROLES[:3] * 4 + ROLES), text))
    out = [(conv, turn, role, text) for conv, turn, role, text in {(r[0], r[1]): r for r in out}.values()]
    out += [(None, 0, "user", "hello."), (None, 1, "assistant", "hi."), (700, None, "user", "a."), (701, 3, None, None)]
    out += [(702, t, "user" if t % 2 else "assistant", "x" * 5000 + f"{t}.") for t in range(40)]
    return out


def expected(rows):
    every, broken = {r[0] for r in rows}, plain_damage(rows)
    out = {}
    for conv in every:
        mine = sorted((r for r in broken if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        out[conv] = plain_report(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_conversations(spark, monkeypatch, tmp_path, bits):
    """Also with conversations that are spread over many stretches."""
    from cadenza.llm.queries import op12_conversations

    monkeypatch.setattr(c, "STRETCH_BITS", bits)
    rows = conversations(5)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(5).write.parquet(path)
    got = {r["conv_id"]: tuple(r)[1:] for r in op12_conversations(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_repeated_rows_and_repaired_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (1, 3, "tool", "ok.")]
    table = c.conversation_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = c.report(table).collect()
    assert [tuple(r) for r in found] == [(1, *plain_report(rows)[:-1])]
    back = c.repaired_rows(table, c.report(table)).orderBy("position").collect()
    assert ["".join(r["role"][0] for r in back), [f"{r['role']}:{r['text']}" for r in back]] == ["ua", plain_repair(rows)[2]]


def test_one_conversation_holds_all_rows(spark):
    rows = [(7, t, ["user", "assistant", "user", "system"][t * t % 4], f"{t % 50}{'.' if t % 7 else ''}") for t in range(9000)]
    table = c.conversation_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(6)
    assert [tuple(r) for r in c.report(table).collect()] == [(7, *plain_report(rows)[:-1])]


def test_no_rows(spark):
    table = c.conversation_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert c.report(c.damaged(table)).count() == 0
    assert c.repaired_digests(table, c.report(table)).count() == 0
