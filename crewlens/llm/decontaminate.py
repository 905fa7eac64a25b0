"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask of token positions; tokens under its gaps are ignored.
The two masks together are lossless for the rule used here: wherever at most 2
of 13 aligned tokens differ, at least one mask fits between the differing
positions, so no qualifying overlap is missed. Training and benchmark seeds
meet in a hash join; each hit fixes a diagonal (document position minus item
position), along which the whole item is compared token by token.

Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlens.llm.common import free_name

WINDOW = 13  # tokens of an overlap that must be aligned
NEEDED = 11  # of them equal: 2 substitutions, a similarity over 0.8
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Items of fewer tokens say too little to tell a leak from ordinary prose.
LEAST_TOKENS = 5
#: Scaled rule: the masks that find every overlap of so many tokens (all of the shorter text), whichever of them differ.
SHORT_MASKS = {
    (0, 1, 2, 3): (4, 8, 9, 12), (0, 1, 2): (3, 5, 6, 7, 10, 11), (0, 1, 4): (5,), (0, 1): (2,), (0,): (1,),
}
#: A text of one token takes part only if it is a run of letters like this, a sentence in a script without spaces.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]{5}"
#: A text with as many tokens as a window, told from its first words; lower-casing never joins two tokens.
AT_LEAST_WINDOW = rf"\A(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{{WINDOW}}}"
#: Benchmark tokens that are broadcast at a time (some 100 bytes each).
BLOCK_TOKENS = 200_000
#: Document positions that are searched together, or those of the longest item.
PIECE_TOKENS = 256


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _needed(wide: Column) -> Column:
    """Equal tokens asked of ``wide`` aligned ones under the scaled rule: at least 0.8 of them."""
    return F.floor((wide * 4 + 4) / 5).cast("int")


def _pieces(rows: DataFrame, around: int) -> DataFrame:
    """``rows`` in runs of positions: ``_words`` is cut to a run and ``around`` tokens on both sides.

    ``_size`` is the size of the whole, ``_from`` the place of the first token kept, ``_lead`` the number
    of tokens before the run and ``_count`` the run's length. A task's generated loop holds all that one
    row leads to, so rows are cut before it: ``transform`` keeps the cut out of that loop.
    """
    step = max(PIECE_TOKENS, around)
    start = F.sequence(F.lit(0), F.col("_size") - 1, F.lit(step))

    def piece(at: Column) -> Column:
        first = F.greatest(at - around, F.lit(0))
        return F.struct(
            first.alias("_from"), (at - first).alias("_lead"), F.least(F.lit(step), F.col("_size") - at).alias("_count"),
            F.slice("_tokens", first + 1, F.lit(step + 2 * around)).alias("_words"),
        )

    whole = rows.withColumnRenamed("_words", "_tokens").withColumn("_size", F.size("_tokens"))
    kept = [c for c in whole.columns if c != "_tokens"]
    return whole.select(*kept, F.inline(F.when(F.col("_size") > 0, F.transform(start, piece))))


def _seeds(rows: DataFrame, words: str, masks: list[tuple[int, ...]], only: dict[int, tuple[int, ...]] | None = None, pieces: bool = False) -> DataFrame:
    """``rows`` times each position and mask that fits there: ``_pos`` and ``_seed``.

    Mask number m is left to texts of the sizes ``only[m]``, if named. With
    ``pieces`` the rows come from ``_pieces`` and ``_pos`` is a place in the whole.
    The word array stays in the task's generated loop: a row is only built for
    the seeds that survive the join.
    """
    n = len(masks)
    size, count = (F.col("_size"), F.col("_count")) if pieces else (F.size(words), F.size(words))
    first, lead = (F.col("_from"), F.col("_lead")) if pieces else (F.lit(0), F.lit(0))
    spread = rows.where(count > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), count * n - 1, F.lit(1))))
    spread = spread.withColumn("_pos", F.floor(F.col("_at") / n).cast("int") + lead + first)
    # one CASE of small numbers and one of hashes that is never null: as a filter on the hash it would be computed twice,
    # and the loop outgrow what the JVM compiles (8000 bytes)
    mask_at = F.col("_at") % n
    last, seed = F.lit(masks[-1][-1]), None
    for m, mask in reversed([*enumerate(masks)]):
        hashed = F.xxhash64(F.lit(m), *[F.get(words, F.col("_pos") - first + F.lit(k)) for k in mask])
        seed = hashed if seed is None else F.when(mask_at == m, hashed).otherwise(seed)
        last = last if m == n - 1 else F.when(mask_at == m, F.lit(mask[-1])).otherwise(last)
    fits = F.col("_pos") + last < size
    for m, sizes in (only or {}).items():
        fits = fits & ((mask_at != m) | size.isin(*sizes))
    return spread.where(fits).withColumn("_seed", seed)


def _window(words: str, at: Column) -> Column:
    """Hash of the tokens from place ``at`` (0 or more) of ``words`` on that any mask may look at."""
    return F.xxhash64(F.slice(words, F.greatest(at, F.lit(0)) + 1, F.lit(MASKS[-1][-1] + 1)))


def _blocks(items: DataFrame, block_tokens: int) -> tuple[int, int]:
    """How many hash blocks keep every block of the benchmark within twice ``block_tokens``; tokens of the longest item."""
    size = items.agg(F.coalesce(F.sum(F.size("_item")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("_item")), F.lit(0)).alias("m"))
    got = size.first()
    n = max(1, math.ceil(got["n"] / block_tokens))
    while n > 1:
        block = F.pmod(F.xxhash64("item_id", "_item"), F.lit(n))
        most = items.groupBy(block.alias("b")).agg(F.sum(F.size("_item")).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        if most <= max(2 * block_tokens, got["m"]):
            break
        n *= 2
    return n, got["m"]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    scaled: bool = False,
) -> DataFrame:
    """One row per document, item and diagonal with a verified overlap.

    ``doc_id``, ``text_hash`` (tells documents with equal ids apart),
    ``item_id``, ``doc_token`` (document token that stands at the item's first;
    negative if the document begins inside the item), ``item_tokens``,
    ``equal_tokens`` (on the diagonal) and ``window_equal`` (the most in any
    window). An overlap counts if some window of 13 aligned tokens has at least
    11 equal; an item of 5 to 12 tokens must be there whole and unchanged.
    With ``scaled`` the window is 13 tokens or the whole of a shorter item or
    document, and at least 0.8 of it must be equal (under 5 tokens: all). Texts
    of one token then count only as sentences in a script without spaces.

    Null and empty texts have no tokens and no leaks. A null id stays null.
    Repeated rows (same id and text) give their leaks once; repeated items too.
    Other columns are ignored; either table may be empty. The benchmark is a
    query set: it is broadcast in blocks of a checked size, each block against
    all documents, so documents are never shuffled. A task holds the hits of one
    piece of a document at a time, each with the tokens along its item only.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text_col).cast("string")).alias("_item"))
    lone = (F.size("_item") == 1) & F.get("_item", F.lit(0)).rlike(UNSPACED)
    items = items.where((F.size("_item") > 1) | lone if scaled else F.size("_item") >= LEAST_TOKENS).distinct()
    short = items.where(F.size("_item") < WINDOW).select(F.size("_item").alias("n")).distinct().collect()  # 12 at most
    sizes = sorted(r["n"] for r in short)
    masks, item_only = [*MASKS], {}
    if scaled:
        for mask, fit in SHORT_MASKS.items():
            if fitting := tuple(n for n in fit if n in sizes):
                item_only[len(masks)] = fitting
                masks.append(mask)
        block_tokens = max(1, block_tokens * len(MASKS) // (len(masks) + len(SHORT_MASKS)))
    else:
        masks += [tuple(range(n)) for n in sizes]
    n_blocks, longest = _blocks(items, block_tokens)
    around = max(longest, MASKS[-1][-1] + 1)
    text = F.col(text_col).cast("string")
    source = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), tokens(text).alias("_words")]
    searches = [(_seeds(_pieces(docs.select(*source), around), "_words", masks, pieces=True), masks, item_only)]
    if scaled:
        # documents shorter than a window, in any item; a pass of their own, so the long ones keep few masks
        brief = docs.where(~text.rlike(AT_LEAST_WINDOW)).select(*source)
        brief = brief.where((F.size("_words") > 1) | F.get("_words", F.lit(0)).rlike(UNSPACED))
        brief = _seeds(_pieces(brief, around), "_words", [*SHORT_MASKS], dict(enumerate(SHORT_MASKS.values())), pieces=True)
        searches.append((brief, [*SHORT_MASKS], None))
    diagonal = F.col("_pos") - F.col("_item_pos")
    lead = F.greatest(-F.col("doc_token"), F.lit(0))  # item tokens before the document begins
    found = None
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "_item"), F.lit(n_blocks)) == b)
        texts = part.select(F.xxhash64("item_id", "_item").alias("_key"), "item_id", "_item")
        for hits, with_masks, only in searches:
            keys = _seeds(part.withColumn("_key", F.xxhash64("item_id", "_item")), "_item", with_masks, only)
            earlier = F.when(F.col("_pos") > 0, _window("_item", F.col("_pos") - 1))
            keys = keys.select("_seed", "_key", F.col("_pos").alias("_item_pos"), F.size("_item").alias("_item_size"), earlier.alias("_earlier"))
            one = hits.join(F.broadcast(keys), "_seed")
            # if all is equal one position earlier, a mask hits there too: the first of a run speaks for its diagonal
            again = (F.col("_pos") > 0) & F.col("_earlier").isNotNull()
            one = one.where(~again | (_window("_words", F.col("_pos") - F.col("_from") - 1) != F.col("_earlier")))
            # an item is compared along its diagonal: no more of the document goes on
            begin = F.greatest(diagonal, F.lit(0))
            span = F.least(F.col("_item_size") - F.greatest(-diagonal, F.lit(0)), F.col("_size") - begin)
            along = F.slice("_words", begin - F.col("_from") + 1, span)
            one = one.select("doc_id", "text_hash", "_size", "_key", diagonal.alias("doc_token"), along.alias("_along"))
            one = one.join(F.broadcast(texts), "_key")
            found = one if found is None else found.union(one)

    equal = F.array_join(
        F.zip_with(
            "_along", F.slice("_item", lead + 1, F.size("_along")),
            lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0")),
        ),
        "",
    )
    # equal tokens by item position, from the first aligned one
    lines = found.select(
        "doc_id", "text_hash", "item_id", "doc_token", F.size("_item").alias("item_tokens"), equal.alias("_equal"),
        (F.least(F.lit(WINDOW), F.size("_item"), F.col("_size")) if scaled else F.least(F.lit(WINDOW), F.size("_item"))).alias("_wide"),
    )
    wide = F.col("_wide")
    need = _needed(wide) if scaled else F.when(F.col("item_tokens") < WINDOW, F.col("item_tokens")).otherwise(F.lit(NEEDED))
    lines = lines.withColumn("equal_tokens", F.length(F.replace("_equal", F.lit("0"), F.lit(""))))
    lines = lines.where(F.col("equal_tokens") >= need).groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_hits"))
    counts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_equal") - wide + 1, F.lit(1)), F.lit(1)),
        lambda i: F.length(F.replace(F.substring(F.col("_equal"), i, wide), F.lit("0"), F.lit(""))),
    )
    lines = lines.withColumn("window_equal", F.array_max(counts))
    return lines.where((F.col("window_equal") >= need) & (F.length("_equal") >= wide)).select(
        "doc_id", "text_hash", "item_id", "doc_token", "item_tokens", "equal_tokens", "window_equal"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """``docs`` without the documents that hold benchmark text; all columns stay, whatever their names.

    A document is told by its id (null too) and the hash of its text, so of rows
    that share an id only those with a leak go, and of repeated rows all.
    """
    leak_id, leak_hash = free_name(docs, "_leak_id"), free_name(docs, "_leak_hash")
    bad = find_leaks(docs, benchmark, id_col, text_col, **named).select(
        F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)
    ).distinct()
    same = F.col(id_col).eqNullSafe(F.col(leak_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(leak_hash))
    return docs.join(bad, same, "left_anti")
