"""Secret scans: fixed patterns, and strings that look random.  DataFrame functions only.

Three base kinds are found by pattern, leftmost and without overlap: `assign` (a key word, = or :, a value
of 6 characters or more), `access` (key ids of 20 or more), `hex` (24 digits or more).  The method adds
`random`: runs of `MIN_RANDOM` or more characters of `ALPHABET` which a Markov model of random strings
explains better than one of ordinary identifiers, by a log-likelihood ratio of `THRESHOLD` or more, and of `MEAN` or
more a pair.  Of a run that fails as a whole its best stretch is judged alike, the one whose pairs exceed `MEAN` by the
greatest sum (of equal ones the first): a random string behind a long path is found, and the span is the stretch.
Both models are chains over pairs of characters, smoothed by one count a pair.  The first learns from the
values of all base spans of all documents; the second from the other words of all documents.

Texts are read twice: for their base spans and long runs, which are kept for training and scoring, and for the
pairs of their other words, of which only the counts leave a task.

Defined results: a null text counts as empty and has no spans.  A failing base match still uses up its
characters.  A run that lies inside a base span adds nothing.  Positions are code points, ends exclusive.
Rows with equal or null ids stay apart.  Very long texts take time in proportion to their matches; other
columns are never read, whatever their names.  Without any base span in the table there is nothing to learn a
random string from, and no `random` span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ids_and_texts, materialized

#: The base patterns, in the order their spans are listed.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]"
MIN_RANDOM = 16
THRESHOLD, MEAN = 10.0, 0.5
#: Matches that are placed together.
GROUP = 256
SPAN = "struct<start: int, end: int, value: string>"


def _bound(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as (start, end, value of the group); positions from the lengths of matches and gaps.

    Matches are placed in groups of `GROUP`, and groups by a running sum of their lengths: appending to one long array
    would copy it for every match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(whole.alias("w"), values.alias("v")),
                        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("size"), m["v"].alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(done: Column, piece: Column) -> Column:
        a = done["at"] + piece["gap"]
        z = a + piece["size"]
        return F.struct(z.alias("at"), F.concat(done["found"], F.array(
            F.struct(a.alias("start"), z.alias("end"), piece["value"].alias("value")))).alias("found"))

    def grouped(matched: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(matched) - 1) / GROUP).cast("int"))
        return F.transform(numbers, lambda g: F.aggregate(F.slice(matched, g * GROUP + 1, F.lit(GROUP)), start, step))

    def offsets(groups: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("of"))
        return F.aggregate(groups["at"], none, lambda done, size: F.struct(
            (done["at"] + size).alias("at"), F.concat(done["of"], F.array(done["at"])).alias("of")))["of"]

    def moved(groups: Column) -> Column:
        return F.flatten(F.zip_with(groups, offsets(groups), lambda g, by: F.transform(g["found"], lambda s: F.struct(
            (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))))

    # The last gap has no match behind it.
    matched = F.filter(pieces, lambda p: p["size"].isNotNull())
    return F.when(text.rlike(pattern), _bound(matched, lambda m: _bound(grouped(m), moved))).otherwise(
        F.array().cast(f"array<{SPAN}>"))


def _covered(spans: Column, s: Column) -> Column:
    """Whether one of the spans, which are in order and apart, covers s: only the last that starts no later can."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(31))])
    last = F.aggregate(steps, F.lit(0).cast("long"), lambda at, step: F.when(
        (at + step <= F.size(spans)) & (F.get(spans, (at + step - 1).cast("int"))["start"] <= s["start"]), at + step).otherwise(at))
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, (last - 1).cast("int"))["end"] >= s["end"], F.lit(False))).otherwise(False)


def _exact_run(characters: str, least: int) -> str:
    """Runs of at least so many: as the runs are maximal, those of the pattern with + that are long enough."""
    return f"{characters}{{{least},}}"


def base_and_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the spans of each base kind, and of the long runs."""
    text = F.col("text")
    return ids_and_texts(docs, id_col, text_col).select(
        "doc_id",
        F.filter(_spans(text, ASSIGN, 1), lambda s: F.length(s["value"]) >= MIN_ASSIGN).alias("assign"),
        # The first AKIA of a run of capitals and digits has the longest rest: if it is short, all are.
        _spans(text, ACCESS.replace("+", f"{{{MIN_ACCESS - 4},}}")).alias("access"),
        _spans(text, _exact_run(HEX[:-1], MIN_HEX)).alias("hex"),
        _spans(text, _exact_run(RUN, MIN_RANDOM)).alias("random"),
    )


def _counted(pairs: DataFrame) -> dict[str, int]:
    """How often each value of column `pair` stands there, a row each: one for any two of `ALPHABET` at most."""
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def _pairs(values: DataFrame) -> dict[str, int]:
    """How often each pair of neighbours stands in column `value`; at most one row a pair leaves."""
    pairs = values.where("length(value) > 1").select(
        F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    return _counted(pairs.where(pairs["pair"].rlike(f"^{RUN}{{2}}$")))


def _chain(counts: dict[str, int]) -> list[float]:
    """Log of the probability of each second character after each first, one count added to each."""
    out = []
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + 1 for b in ALPHABET]
        out += [math.log(n / sum(row)) for n in row]
    return out


def train(docs: DataFrame, found: DataFrame) -> list[float] | None:
    """For each pair of characters the log of its odds, random to ordinary."""
    base = F.concat("assign", "access", "hex")
    random = _pairs(found.select(F.explode(base).alias("s")).select("s.value"))
    if not random:
        return None
    others = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{_exact_run(HEX[:-1], MIN_HEX)}", " ")
    # Looking ahead, a match takes no character: each pair of each word is found in one pass.
    ordinary = _counted(ids_and_texts(docs).select(
        F.explode(F.regexp_extract_all(others, F.lit(f"(?=({RUN}{{2}}))"), F.lit(1))).alias("pair")))
    return [a - b for a, b in zip(_chain(random), _chain(ordinary))]


def _odds(value: Column, model: list[float]):
    """The log odds of the pair at a position (from 1); the model is one folded constant."""
    table = F.split(F.lit(" ".join(f"{x:.9f}" for x in model)), " ").cast("array<double>")

    def symbol(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), value.substr(i, F.lit(1))) - 1

    return lambda i: F.get(table, symbol(i) * len(ALPHABET) + symbol(i + 1))


def _pair_numbers(value: Column) -> Column:
    return F.sequence(F.lit(1), F.length(value) - 1)


def log_odds(value: Column, model: list[float]) -> Column:
    """The sum over a string's pairs."""
    odds = _odds(value, model)
    return F.aggregate(_pair_numbers(value), F.lit(0.0), lambda total, i: total + odds(i))


def best_stretch(value: Column, model: list[float], mean: float = MEAN) -> Column:
    """first (the character it begins with, from 1), pairs and sum of the contiguous pairs whose odds exceed `mean`
    by the greatest sum, in one pass: a stretch goes on while its excess is positive, else a new one begins."""
    odds = _odds(value, model)
    nothing = F.struct(*[x.alias(n) for n, x in (
        ("begun", F.lit(1)), ("excess", F.lit(0.0)), ("first", F.lit(1)), ("pairs", F.lit(0)), ("most", F.lit(0.0)))])

    def step(done: Column, i: Column) -> Column:
        def extended(x: Column) -> Column:
            goes_on = done["excess"] > 0
            begun = F.when(goes_on, done["begun"]).otherwise(i)
            return _bound(F.struct(begun.alias("begun"), (F.when(goes_on, done["excess"]).otherwise(0.0) + x).alias("excess")), lambda now: F.struct(
                now["begun"].alias("begun"), now["excess"].alias("excess"),
                F.when(now["excess"] > done["most"], now["begun"]).otherwise(done["first"]).alias("first"),
                F.when(now["excess"] > done["most"], i - now["begun"] + 1).otherwise(done["pairs"]).alias("pairs"),
                F.greatest(now["excess"], done["most"]).alias("most")))
        return _bound(odds(i) - mean, extended)

    return F.aggregate(_pair_numbers(value), nothing, step, lambda done: F.struct(
        done["first"].alias("first"), done["pairs"].alias("pairs"), (done["most"] + mean * done["pairs"]).alias("sum")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and, for each kind, its spans (start, end, value), by start."""
    found = materialized(base_and_runs(docs, id_col, text_col), "secret-spans")
    model = train(docs.withColumns({"doc_id": docs[id_col], "text": docs[text_col]}), found)

    def outside(s: Column) -> Column:
        return ~(_covered(F.col("assign"), s) | _covered(F.col("access"), s) | _covered(F.col("hex"), s))

    def judged(s: Column) -> Column:
        """The run, its best stretch, or null."""
        whole = log_odds(s["value"], model) >= F.greatest(F.lit(threshold), MEAN * (F.length(s["value"]) - 1))
        part = _bound(best_stretch(s["value"], model), lambda b: F.when(
            (b["sum"] >= threshold) & (b["pairs"] >= MIN_RANDOM - 1), F.struct(
                (s["start"] + b["first"] - 1).alias("start"), (s["start"] + b["first"] + b["pairs"]).alias("end"),
                s["value"].substr(b["first"], b["pairs"] + 1).alias("value"))))
        return F.when(whole, s).otherwise(part)

    none = F.array().cast(f"array<{SPAN}>")
    # A stretch may still lie inside a base span where its run did not.
    random = F.filter(F.transform(F.filter("random", outside), judged), lambda s: s.isNotNull()) if model else none
    found = found.withColumn("random", random)
    return found.withColumn("random", F.filter("random", outside)) if model else found


def listed(*kinds: str) -> Column:
    """kind:start:end of the kinds' spans, by start, then by kind as listed; comma-joined."""
    def placed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        F.sort_array(F.concat(*map(placed, kinds))),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
