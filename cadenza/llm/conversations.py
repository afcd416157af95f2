"""Repair of conversation structure by a grammar-compressed dynamic program.

A conversation is right if the initials of its roles read `(s?(ua)+)?`.  Rows are kept (cost 0), given the role user or
assistant (1), deleted (2; a must for blank and repeated rows), or empty rows of user or assistant inserted
(5); a truncated row that stays costs 5 more.  The cheapest edits win, of equally cheap ones the
ASCII-least string of their initials D, I, K, R.

All this depends on a row's role initial and first fault only: one of 16 letters.  What a string of letters does to the four
states of the pattern (nothing yet, after s, after u, after a) is a matrix of (cost, edits) whose product is
the least cost, then the least string.  Strings that share a batch are compressed by Re-Pair: the most frequent
pair of neighbours becomes a rule, over and over.  Each rule's matrix is made once, from those of its two parts, its
edits a rope of theirs, and serves every conversation in which the rule occurs.

A conversation of any length is spread over tasks: rows without their texts are put in order by ranges of the
whole sort key, cut into stretches of at most `STRETCH` entries, and each stretch becomes one matrix; a
conversation's few matrices are then multiplied in order.  Only the repaired rows themselves are walked through
in one task per conversation, one row at a time, as a digest of the whole allows no other way.

Defined results: null roles and texts count as one space, a null conv_id is a conversation of its own, null turns come first.
Rows of equal turn go by role, then by a hash of the text.  Repeated rows are duplicates of each other and all
but one must go; equality of texts is that of two 64-bit hashes.  Very long texts are never held but
one at a time; other columns are never read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialized, ship, shuffle_tasks

SPACE = " \t\n\x0b\x0c\r"
STRETCH_BITS = 12
STRETCH = 1 << STRETCH_BITS
#: Rules of a batch, and how often a pair must stand in it to become one.
RULES = 128
OFTEN = 3

KINDS = ["blank", "duplicate", "truncated", "fine"]
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
_NEVER = None


# The algebra: entries are (cost, rope) or None; a rope is a string or a pair of ropes.

def flat(rope) -> str:
    parts, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(parts)


def least(one, two):
    if one is None or two is None:
        return two if one is None else one
    if one[0] != two[0]:
        return one if one[0] < two[0] else two
    return one if one[1] is two[1] or flat(one[1]) <= flat(two[1]) else two


def joined(one, two):
    if one is None or two is None:
        return _NEVER
    return one[0] + two[0], (one[1], two[1]) if one[1] and two[1] else one[1] or two[1]


def product(one: list, two: list) -> list:
    """Rows of entries times a 4 x 4 matrix."""
    out = []
    for row in one:
        line = []
        for j in range(4):
            best = _NEVER
            for k in range(4):
                if row[k] is not None and two[k][j] is not None:
                    cost = row[k][0] + two[k][j][0]
                    if best is None or cost <= best[0]:
                        best = least(best, joined(row[k], two[k][j]))
            line.append(best)
        out.append(line)
    return out


#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
INSERTS = [[_NEVER] * 4 for _ in range(4)]
for _i in range(4):
    INSERTS[_i][_i] = (0, "")
for _i, _j, _edits in ((0, 2, "I"), (0, 3, "II"), (1, 2, "I"), (1, 3, "II"), (2, 3, "I"), (3, 2, "I")):
    INSERTS[_i][_j] = (5 * len(_edits), _edits)


def letter(kind: int, initial: int) -> str:
    return chr(ord("a") + 4 * kind + initial)


def letter_matrix(code: int) -> list:
    kind, initial = KINDS[code // 4], "sua?"[code % 4]
    row = [[_NEVER] * 4 for _ in range(4)]
    for state in range(4):
        row[state][state] = (2, "D")
        if kind in ("blank", "duplicate"):
            continue
        extra = 5 if kind == "truncated" else 0
        for role, cost, edit in ((initial, 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
            to = _STEP.get((role, state))
            if to is not None:
                row[state][to] = least(row[state][to], (cost + extra, edit))
    return product(INSERTS, row)


LETTERS = [letter_matrix(c) for c in range(16)]


def repair_grammar(strings: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Re-Pair over all strings at once: the rules, whose numbers start at 16, and each string in symbols."""
    codes = [np.frombuffer(s.encode(), np.uint8).astype(np.int64) - ord("a") for s in strings]
    gap = np.array([-1])
    x = np.concatenate([p for c in codes for p in (c, gap)]) if codes else gap
    rules: list[tuple[int, int]] = []
    while len(rules) < RULES:
        pairs = np.where((x[:-1] >= 0) & (x[1:] >= 0), (x[:-1] << 20) | x[1:], -1)
        seen, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        if not len(seen) or counts.max() < OFTEN:
            break
        best = int(seen[counts.argmax()])
        at = np.flatnonzero(pairs == best)
        # of overlapping places, in a run of one symbol, every other one
        first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        run = np.repeat(at[first], np.diff(np.r_[first, len(at)]))
        at = at[(at - run) % 2 == 0]
        x[at] = 16 + len(rules)
        x = np.delete(x, at + 1)
        rules.append((best >> 20, best & (1 << 20) - 1))
    ends = np.flatnonzero(x < 0)
    starts = np.r_[0, ends[:-1] + 1]
    return rules, [x[a:z].tolist() for a, z in zip(starts, ends)][:len(strings)]


def matrices(strings: list[str]) -> list[list]:
    """The matrix of each string, by the rules they share."""
    rules, symbols = repair_grammar(strings)
    known = list(LETTERS)
    for left, right in rules:
        known.append(product(known[left], known[right]))
    out = []
    for string in symbols:
        total = known[string[0]] if string else [[(0, "") if i == j else _NEVER for j in range(4)] for i in range(4)]
        for symbol in string[1:]:
            total = product(total, known[symbol])
        out.append(total)
    return out


def closing(states: list) -> tuple[int, str]:
    """The best end of a row of entries: inserts may follow, and the states 0 and 3 are right."""
    ended = product([states], INSERTS)[0]
    best = least(ended[0], ended[3])
    return best[0], flat(best[1])


# On Spark

def _hashes(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), role, text).alias(f"h{i}") for i in (1, 2)]


def conversation_rows(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text; nulls of the last two as one space."""
    ship(table.sparkSession)
    return table.select(
        table[conv_col].cast("long").alias("conv_id"), table[turn_col].cast("long").alias("turn"),
        F.coalesce(table[role_col], F.lit(" ")).alias("role"), F.coalesce(table[text_col], F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of `conversation_rows` with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 gives it the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    marked = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies)).drop("col")


def stretches(rows: DataFrame) -> DataFrame:
    """conv_id, stretch, the letters of its rows in order, and the turns it holds: least, greatest, how many."""
    tail = F.rtrim("text", F.lit(SPACE))
    kind = F.when(tail == "", 0).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), 3).otherwise(2)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    slim = rows.select(
        "conv_id", "turn", "role", *_hashes(F.col("role"), F.col("text")), kind.alias("kind"),
        F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"))
    same = ["conv_id", "role", "h1", "h2"]
    counted = slim.groupBy(*same, "turn").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("initial").alias("initial"))
    first = counted.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"))
    def letters(kind: Column) -> Column:
        return F.char(F.lit(ord("a")) + 4 * kind + F.col("initial"))

    again = letters(F.least("kind", F.lit(1)))
    opening = F.when(F.col("turn").eqNullSafe(F.col("first.turn")), letters(F.col("kind"))).otherwise(again)
    entries = counted.join(first.select(*[first[c].alias(f"_{c}") for c in same], "first"), _renamed(counted, same)).select(
        "conv_id", "turn", "role", "h1", "h2",
        F.concat(opening, F.repeat(again, (F.col("n") - 1).cast("int"))).alias("letters"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h1", "h2"]
    placed = materialized(
        entries.repartitionByRange(shuffle_tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
        .select("conv_id", "turn", "letters", F.monotonically_increasing_id().alias("at")), "turns-in-order")
    # The rows of a file have ascending numbers, so a stretch is a stretch of one conversation.
    parts = placed.groupBy("conv_id", F.shiftright("at", STRETCH_BITS).alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("at", "letters", "turn"))).alias("entries"))
    turns = F.filter(F.col("entries.turn"), lambda t: t.isNotNull())
    return parts.select(
        "conv_id", "stretch", F.array_join("entries.letters", "").alias("letters"),
        F.array_min(turns).alias("first_turn"), F.array_max(turns).alias("last_turn"), F.size(F.array_distinct(turns)).alias("turns"))


def _renamed(left: DataFrame, columns: list[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(F.col(f"_{c}"))
    return on


def _stretch_matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        strings = batch["letters"].unique().tolist()
        entries = dict(zip(strings, ([e for row in m for e in row] for m in matrices(strings))))
        found = [entries[s] for s in batch["letters"]]
        batch["costs"] = [[-1 if e is None else e[0] for e in m] for m in found]
        batch["edits"] = [["" if e is None else flat(e[1]) for e in m] for m in found]
        yield batch


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Fold:
    """One conversation, stretch by stretch."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.states = [(0, ""), _NEVER, _NEVER, _NEVER]
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.last = self.lowest = self.highest = None

    def add(self, row) -> None:
        roles = ["sua?"[(ord(c) - ord("a")) % 4] for c in row.letters]
        before = roles[:-1] if self.last is None else [self.last, *roles[:-1]]
        after = roles[1:] if self.last is None else roles
        self.illegal += sum(a + b not in LEGAL for a, b in zip(before, after))
        self.last = roles[-1]
        for c in row.letters:
            self.counts[(ord(c) - ord("a")) // 4] += 1
        if row.turns:
            self.turns += row.turns - (self.highest == row.first_turn)
            self.lowest = row.first_turn if self.lowest is None else self.lowest
            self.highest = row.last_turn
        matrix = [[_NEVER if row.costs[4 * i + j] < 0 else (row.costs[4 * i + j], row.edits[4 * i + j]) for j in range(4)] for i in range(4)]
        self.states = product([self.states], matrix)[0]

    def line(self) -> tuple:
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        return self.conv_id, int(gaps), *self.counts[:3], self.illegal, *closing(self.states)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in REPORT.split(", ")]

    def table(done):
        return pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})

    now = None
    for batch in batches:
        done = []
        batch["conv_id"] = batch["conv_id"].astype("Int64").astype(object).where(batch["conv_id"].notna(), None)
        for row in batch.itertuples(index=False):
            if now is None or row.conv_id != now.conv_id:
                done += [now.line()] if now else []
                now = _Fold(row.conv_id)
            now.add(row)
        yield table(done)
    if now:
        yield table([now.line()])


def report(rows: DataFrame) -> DataFrame:
    """Faults, the least cost and its edits, one row per conversation that has rows."""
    parts = stretches(rows)
    solved = parts.mapInPandas(
        _stretch_matrices, ", ".join(f"{c} {t}" for c, t in parts.dtypes) + ", costs array<long>, edits array<string>")
    n = shuffle_tasks(rows.sparkSession)
    return solved.repartition(n, "conv_id").sortWithinPartitions("conv_id", "stretch").mapInPandas(_fold, REPORT)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Conversation by conversation, in order: (conv_id, turn, role, text, edit) of the rows that stay, and
    (conv_id, None, None, None, None) where a conversation starts."""
    conv, audit, at, state, started = None, "", 0, 0, False

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "assistant" if state == 2 else "user"
            at, state = at + 1, 3 if state == 2 else 2
            yield conv, None, role, "", "I"

    for batch in batches:
        ids = batch["conv_id"].astype("Int64").astype(object).where(batch["conv_id"].notna(), None)
        turns = batch["turn"].astype("Int64").astype(object).where(batch["turn"].notna(), None)
        for row_conv, audit_row, turn, role, text in zip(ids, batch["is_audit"], turns, batch["role"], batch["text"]):
            if audit_row:
                if started:
                    yield from inserted()
                conv, audit, at, state, started = row_conv, text, 0, 0, True
                yield conv, None, None, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            state = _STEP[role[0], state]
            yield conv, turn, role, text, edit
    if started:
        yield from inserted()


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows in order behind their conversation's edits, one conversation after the other in a task."""
    columns = ["conv_id", "turn", "role", "text"]
    texts = rows.select(*columns, *_hashes(F.col("role"), F.col("text")), F.lit(False).alias("is_audit"))
    audits = found.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
        F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(True).alias("is_audit"))
    return texts.unionByName(audits).repartition(shuffle_tasks(rows.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", F.col("is_audit").desc(), F.col("turn").asc_nulls_first(), "role", "h1", "h2").select(*columns, "is_audit")


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, position, turn (null of an inserted row), role, text and edit of the repaired conversations."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, position = [], 0
        columns = ["conv_id", "position", "turn", "role", "text", "edit"]

        def table():
            return pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})

        for conv, turn, role, text, edit in _edited(batches):
            if edit is None:
                position = 0
                continue
            position += 1
            out.append((conv, position, turn, role, text, edit))
            if len(out) == 2000:
                yield table()
                out = []
        yield table()

    return _with_audits(rows, found).mapInPandas(run, "conv_id long, position long, turn long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the sha256 of the repaired conversation: lines of role:text, joined by newlines."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, digest, empty, now = [], None, True, None

        def table():
            return pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})

        for conv, _, role, text, edit in _edited(batches):
            if edit is None:
                if digest:
                    out.append((now, digest.hexdigest()))
                digest, empty, now = hashlib.sha256(), True, conv
                if len(out) == 5000:
                    yield table()
                    out = []
                continue
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if digest:
            out.append((now, digest.hexdigest()))
        yield table()

    return _with_audits(rows, found).mapInPandas(run, "conv_id long, repaired_sha256 string")
