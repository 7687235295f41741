"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

Words: the lower-cased text split at everything but letters and digits. A document holds an item if, with the item laid
along it at some place, ``WINDOW`` = 13 neighbouring words (the whole of a shorter item) agree in four fifths or more.
Seeds: two fixed masks over 8 words pick 6 each; at every place of items and documents their hashes are taken and
joined. The masks are such that each 13 words with at most two substitutions hold a hit of one of them. Each hit names
an item and a place to lay it along; these are verified word by word. An item of 5 to 12 words may differ in one word
(10 to 12: two), so two (three) solid masks that divide it find it. Shorter items must be there as they are: one mask
over all their words finds them, so an item of one word is found wherever that word is.

The items' seeds are broadcast if they are counted to be few (``BROADCAST`` at most): then nothing but verified hits
moves. Otherwise Spark joins by shuffle, whose hot keys it may split.

Null texts and null items have no words. A row is known by doc_id and its text's hash, nulls as values, so rows
with one id and different texts are told apart; equal rows share their fate. Repeated items are found each. A null
item_id is a value: its items are found and reported under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SHARE = 13, 0.8
#: The masks' chosen positions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Seeds (of some 50 bytes) that are broadcast at most.
BROADCAST = 400_000


def word_hashes(text: Column) -> Column:
    """array<bigint>: a hash of each word of the text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda x: F.xxhash64(x))


def _solid(length: int) -> list[tuple[int, ...]]:
    """Solid masks that divide a short item into one part more than it may have wrong words."""
    parts = 1 + (length >= 5) + (length >= 10)
    cuts = [length * k // parts for k in range(parts + 1)]
    return [tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _seeds(rows: DataFrame, masks: list[tuple[str, tuple[int, ...]]], keep: list[str]) -> DataFrame:
    """A row for each place and mask of ``rows`` (with ``h``): the place of the item's or text's word 0, and the hash.

    ``masks``: a name that goes into the hash, and positions from a place on.
    """
    at = rows.select(*dict.fromkeys([*keep, "h"]), F.posexplode_outer("h").alias("at", "_word"))  # outer: else a filter computes h a second time
    last = lambda picks: F.get("h", F.col("at") + picks[-1]).isNotNull()
    seeds = [F.when(last(picks), F.xxhash64(F.lit(name), *[F.get("h", F.col("at") + k) for k in picks])) for name, picks in masks]
    out = at.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))
    return out.where("seed is not null")


def _agreement(item: Column, h: Column, n: Column, place: Column) -> Column:
    """struct<bits, best, total>: the most agreeing words in ``WINDOW`` neighbouring ones, and in all."""
    # the text's words beside the item's; those before the text's start are null
    early = F.concat(F.array_repeat(F.lit(None).cast("long"), -place), F.slice(h, F.lit(1), F.greatest(n + place, F.lit(0))))
    beside = F.when(place >= 0, F.slice(h, F.greatest(place, F.lit(0)) + 1, n)).otherwise(early)
    equal = F.zip_with(item, beside, lambda x, y: F.when(x == y, 1).otherwise(0))

    def step(a: Column, x: Column) -> Column:
        bits = F.shiftleft(a["bits"], 1).bitwiseOR(x).bitwiseAND(F.lit((1 << WINDOW) - 1))
        return F.struct(bits.alias("bits"), F.greatest(a["best"], F.bit_count(bits)).alias("best"), (a["total"] + x).alias("total"))

    none = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("best"), F.lit(0).alias("total"))
    return F.aggregate(equal, none, step)


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, text_hash, item_id, n_equal, n_words: which documents hold which items.

    n_words: the item's words; n_equal: those that agree where the item lies best. One row per document and item.
    With at most ``broadcast`` seeds, hits are verified as they are found; with more, they are put together first, and
    the texts that have some are read again.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0).withColumn("n", F.size("h")).distinct()
    shorts = sorted(x[0] for x in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 12 lengths
    masks = [(f"m{k}", picks) for k, picks in enumerate(MASKS)]
    short = [(f"s{n}.{k}", picks) for n in shorts for k, picks in enumerate(_solid(n))]
    wanted = [_seeds(items.where(F.col("n") >= WINDOW), masks, ["item_id", "n"]).select("item_id", "n", "seed", F.col("at").alias("item_at"))]
    for name, picks in short:
        n = int(name[1:].split(".")[0])
        h = [F.get("h", F.lit(k)) for k in picks]
        wanted.append(items.where(F.col("n") == n).select("item_id", "n", F.xxhash64(F.lit(name), *h).alias("seed"), F.lit(picks[0]).alias("item_at")))
    seeds = wanted[0]
    for more in wanted[1:]:
        seeds = seeds.union(more)
    few = seeds.count() <= broadcast
    small = F.broadcast if few else lambda df: df
    whole = small(items.select(F.col("item_id").alias("__item"), F.col("n").alias("__n"), F.col("h").alias("item")))
    of = F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("n") == F.col("__n"))
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("h"))
    keep = ["doc_id", "text_hash", *["h"] * few]
    # a solid mask's place in a text is that of its first word
    found = _seeds(texts, masks + [(name, tuple(k - picks[0] for k in picks)) for name, picks in short], keep).join(small(seeds), "seed")
    laid = found.select(*keep, "item_id", "n", (F.col("at") - F.col("item_at")).alias("place"))
    if few:
        rows = laid.join(whole, of)
    else:
        known = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.text_hash") == F.col("p.text_hash"))
        own = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).distinct().alias("t")
        rows = own.join(laid.distinct().join(whole, of).alias("p"), known).select("p.*", word_hashes(F.col("t.text")).alias("h"))
    # h must not come into a lambda: it would be computed for each of its steps
    rows = rows.select("doc_id", "text_hash", "item_id", "n", _agreement(F.col("item"), F.col("h"), F.col("n"), F.col("place")).alias("a"))
    good = rows.where(F.col("a.best") >= F.ceil(SHARE * F.least(F.col("n"), F.lit(WINDOW))))
    return good.groupBy("doc_id", "text_hash", "item_id").agg(F.max("a.total").cast("long").alias("n_equal"), F.max("n").cast("long").alias("n_words"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold an item."""
    bad = contaminated(documents, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
