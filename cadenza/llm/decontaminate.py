"""Benchmark decontamination by spaced seeds.  DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text.  A mask such as 1101011 covers a
span of words and ignores the positions marked 0; the words it keeps are hashed.  Hashes of the
benchmark and of every position of every document are joined by equality, so a passage is found
although words of it were replaced, as long as one mask fits between the replacements.  Around a hit
the passages are compared word by word, and only the words within reach of a hit go along with it: of some `window` words in a row that hold the seed, on the
same alignment, `similarity` must agree (an item shorter than the window counts as a whole).

Positions and hashes are made row by row inside one generated stage and meet the benchmark there;
nothing of the documents is shuffled but the few hits.  The seeds are broadcast only if they were
counted and are at most `BROADCAST_SEEDS`; more of them are joined by a shuffle, with equal results.

Items of 8 words or more are laid under `MASKS`, shorter ones under masks of their own (`SHORT`): four words of five
to seven, so that one replaced word is found wherever it stands, or all words of four or fewer, of which `similarity`
lets none differ.  Documents are hashed under the masks that some item uses: the lengths of items, up to 8, are looked
up first.

Defined results: null or empty texts and items without a word give no overlap, nor do texts that a mask does not fit in.
Rows with the same id count as one document; a null id is an id like any other.  Benchmark items of one id
count as one item, which overlaps by the best of its texts.  A very long text is a row of its words.  An empty
table on either side gives an empty result; columns besides ids and texts are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import merged_columns

#: Each keeps five words; the positions marked 0 may differ.
MASKS = ("11111", "1101011", "11001101")
#: The masks of items of so many words.
SHORT = {n: ("1111", "11011", "10111", "11101") if n > 4 else ("1" * n,) for n in range(1, 8)}
#: A mask's place in this list is its number in the hash.
ALL_MASKS = (*MASKS, *sorted({m for ms in SHORT.values() for m in ms}))
WINDOW = 13
SIMILARITY = 0.8
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def masks_of(n_words: int) -> tuple[str, ...]:
    return SHORT.get(n_words, MASKS) if n_words else ()


def _seeds(masks: list[str], by_length: bool, at: str = "at", array: str = "words") -> Column:
    """The hash of each mask laid at word `at` (from 0); null where it does not fit, or by length is not used."""
    def one(mask: str) -> str:
        number = ALL_MASKS.index(mask)
        kept = ", ".join(f"get({array}, {at} + {i})" for i, c in enumerate(mask) if c == "1")
        lengths = [n for n in range(1, 9) if mask in masks_of(n)]
        used = f" AND least(size({array}), 8) IN ({', '.join(map(str, lengths))})" if by_length else ""
        return f"CASE WHEN {at} + {len(mask)} <= size({array}){used} THEN xxhash64({number}, {kept}) END"
    return F.expr(f"array({', '.join(map(one, masks))})")


def _positions(table: DataFrame, masks: list[str], *keep: str, by_length: bool = False) -> DataFrame:
    """A row per word position and mask."""
    shortest = min(map(len, masks))
    # Outer, as for the inner form a filter is inferred that splits every text a second time.
    at = table.select(*keep, "words", F.explode_outer(F.when(
        F.size("words") >= shortest, F.sequence(F.lit(0), F.size("words") - shortest))).alias("at"))
    return at.select(*keep, "words", "at", F.explode(_seeds(masks, by_length)).alias("seed")).where("seed IS NOT NULL")


def _around(words: str, at: str, window: int) -> Column:
    """The words that a window over word `at` can reach."""
    return F.expr(f"slice({words}, greatest({at} - {window - 1}, 0) + 1, {2 * window - 1})")


def _agreement(window: int) -> Column:
    """The most words that agree in any `span` words in a row around the hit, on its alignment.

    A span as long as the window, or the item if that is shorter, slides over the hit.  `near` and `item_near` hold the
    words `_around` the hit's places in text and item.
    """
    span = f"least({window}, item_size)"
    text_word = f"get(near, at - item_at + j - greatest(at - {window - 1}, 0))"
    item_word = f"get(item_near, j - greatest(item_at - {window - 1}, 0))"
    agree = f"CASE WHEN {text_word} = {item_word} THEN 1 ELSE 0 END"
    starts = f"sequence(greatest(0, item_at - {span} + 1), least(item_at, item_size - {span}))"
    return F.expr(
        f"array_max(transform({starts}, s -> aggregate(sequence(s, s + {span} - 1), 0, (n, j) -> n + {agree})))")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY,
             broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, n_agree (of the best window), n_window, first_word (where in the document the
    first such window's seed stands): a row for each document and item that overlap."""
    items = benchmark.select(
        benchmark["item_id"].cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), words(benchmark["text"]).alias("words"))
    # Eight numbers at most.
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(8))).distinct().collect()]
    masks = [m for m in ALL_MASKS if any(m in masks_of(n) for n in lengths)] or [*MASKS]
    # A seed names its item's text and does not carry it: what is broadcast is bounded by the number of seeds.
    seeds = _positions(items, masks, "item_id", "item_hash", by_length=True).select("item_id", "item_hash", F.col("at").alias("item_at"), "seed")
    named = items.distinct().select(
        F.col("item_id").alias("same_item"), F.col("item_hash").alias("same_hash"), F.col("words").alias("item_words"))
    same_item = F.col("same_item").eqNullSafe(F.col("item_id")) & (F.col("same_hash") == F.col("item_hash"))
    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words(docs["text"]).alias("words"))
    where = _positions(texts, masks, "doc_id", "text_hash")
    # All hits of a text leave the generated stage together, so a hit takes along the words it is judged by, not the whole text.
    near = _around("words", "at", window).alias("near")
    if seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        met = where.join(F.broadcast(seeds), "seed").select("doc_id", "at", near, *seeds.drop("seed").columns).join(named, same_item)
    else:
        # Only places are shuffled; where seeds agree, the words are fetched.
        met = (
            where.drop("words").join(seeds, "seed").join(named, same_item)
            .join(texts.withColumnRenamed("doc_id", "id"), F.col("id").eqNullSafe(F.col("doc_id"))
                  & (texts["text_hash"] == where["text_hash"])))
    # As a generator the comparison stays behind the join: as part of the join's condition it would
    # take the join, and the words of every position, out of the generated stage.
    met = met.select(
        "doc_id", "item_id", "at", "item_at", "near" if "near" in met.columns else near,
        _around("item_words", "item_at", window).alias("item_near"), F.size("item_words").alias("item_size"))
    size = F.least(F.lit(window), F.col("item_size"))
    hits = met.select(
        "doc_id", "item_id", "at", size.alias("n_window"), F.explode_outer(F.array(_agreement(window))).alias("n_agree"))
    return (
        hits.where(F.col("n_agree") >= similarity * F.col("n_window"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_agree").cast("long").alias("n_agree"), F.max("n_window").cast("long").alias("n_window"),
             F.min("at").cast("long").alias("first_word"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of `docs` that overlap no item.  A row without an id is judged by all such rows."""
    found = overlaps(docs, benchmark, **parameters).select(F.col("doc_id").alias("found_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("id"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left_anti").select(*merged_columns(docs, {}))


def _oracle() -> str:
    """The same in SQL, with the words a mask keeps in place of their hash."""
    def positions(name: str, key: str) -> str:
        def used(mask: str) -> str:
            lengths = ", ".join(str(n) for n in range(1, 9) if mask in masks_of(n))
            those = f"least(len(words), 8) IN ({lengths})"
            return those if name == "item" else f"EXISTS (SELECT 1 FROM item_words WHERE {those})"

        picks = " UNION ALL ".join(
            f"SELECT {key}, words, p, {i} AS mask, "
            + " || ' ' || ".join(f"words[p + {j + 1}]" for j, c in enumerate(m) if c == "1")
            + f" AS seed FROM {name}_spot WHERE p + {len(m)} <= len(words) AND {used(m)}" for i, m in enumerate(ALL_MASKS))
        return (f"{name}_spot AS (SELECT {key}, words, unnest(range(0, len(words))) AS p"
                f" FROM {name}_words WHERE len(words) >= 1), {name}_seed AS ({picks})")

    split = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words"
    span = f"least({WINDOW}, len(i.words))"
    agree = f"""list_max([list_sum([CASE WHEN d.words[d.p - i.p + j + 1] = i.words[j + 1] AND d.p - i.p + j >= 0
        THEN 1 ELSE 0 END for j in range(s, s + {span})])
        for s in range(greatest(0, i.p - {span} + 1), least(i.p, len(i.words) - {span}) + 1)])"""
    return f"""
        WITH doc_words AS (SELECT doc_id, {split} FROM documents),
        item_words AS (SELECT item_id, {split} FROM benchmark),
        {positions('doc', 'doc_id')}, {positions('item', 'item_id')},
        hit AS (SELECT doc_id, item_id, d.p, {span} AS n_window, {agree} AS n_agree
            FROM doc_seed d JOIN item_seed i ON d.mask = i.mask AND d.seed = i.seed)
        SELECT doc_id, item_id, CAST(max(n_agree) AS BIGINT) AS n_agree, CAST(max(n_window) AS BIGINT) AS n_window,
            CAST(min(p) AS BIGINT) AS first_word
        FROM hit WHERE n_agree >= {SIMILARITY} * n_window GROUP BY doc_id, item_id"""


ORACLE_SQL = _oracle()
