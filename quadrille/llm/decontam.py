"""Benchmark decontamination as a prefix-filtered set join, in SQL functions only.

A window (13 item words, or the whole of a shorter item) is contained in a
document only if each of its tokens is; so, with tokens ordered by rarity over
all documents, the prefix of a window that must be met is its rarest token.
Document positions join those prefix tokens; a candidate must leave room for the
window on both sides (positional and length bound) and is then verified word by
word over the item-sized window.

Prefix tokens are broadcast in pieces of a bounded size, so words that no window
needs never reach a shuffle. Up to ``BROADCAST_WINDOWS`` windows their words come
along and verify in place. Beyond that, the item-sized slices at the candidate
places are joined with the windows on the words themselves, salted, so that a
passage found in a third of all documents is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filed, located, lower_ascii, staged

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (a few hundred bytes each) up to which they are broadcast whole; larger sets are joined by a shuffle of the candidate slices.
BROADCAST_WINDOWS = 100_000
#: Most prefix tokens in one broadcast; more make more passes over the documents.
PIECE_TOKENS = 500_000
SALTS = 8
#: Stands behind the last word of a document and is no word: every document has one row.
CLOSE = ""


def words_of(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, win): distinct windows of each item; items without words have none."""
    words = items.select(items[id_col].cast("string").alias("item"), words_of(items[text_col].cast("string")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    return words.select("item", "words", F.explode(starts).alias("i")).select("item", F.slice("words", F.col("i"), window).alias("win")).distinct()


def rarest(rows: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(win, its, w, off): each window with its items, its rarest token over all documents, and where in it that is."""
    vocabulary = windows.select(F.explode("win").alias("w")).distinct()
    met = rows.select(F.explode_outer("words").alias("w"))
    # a large vocabulary meets counts that were combined before the shuffle
    met = met.join(F.broadcast(vocabulary), "w") if small else met
    rarity = met.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    tokens = windows.groupBy("win").agg(F.collect_set("item").alias("its")).select("win", "its", F.posexplode("win").alias("off", "w"))
    # a window whose rarest token occurs nowhere can't be contained
    ranked = tokens.join(rarity, "w", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    best = ranked.groupBy("win").agg(F.min(F.struct("n", "w", "off")).alias("p"), F.first("its").alias("its")).filter("p.n > 0")
    return staged(best.select("win", "its", "p.w", "p.off"), "decontam-prefixes")


def hit_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """(_id, _loc, n_words, start, len, its) of a file scan: one row a place where a window occurs, and one with null start for every document."""
    windows = staged(item_windows(items, window=window), "decontam-windows")
    small = windows.count() <= broadcast_windows
    rows = located(docs, _id=docs[id_col], words=words_of(docs[text_col].cast("string"))).select("_id", "_loc", F.size("words").alias("n_words"), F.array_append("words", CLOSE).alias("words"))
    prefix = rarest(rows, windows, small)

    start = F.col("pos") - F.col("off")
    places = rows.select("_id", "_loc", "n_words", "words", F.posexplode_outer("words").alias("pos", "w"))
    close = prefix.sparkSession.range(1).select(F.lit(CLOSE).alias("w"))
    if small:
        table = prefix.groupBy("w", "off", "win").agg(F.flatten(F.collect_list("its")).alias("its")).unionByName(close, allowMissingColumns=True)
        length = F.size("win")
        fits = (start >= 0) & (start + length <= F.col("n_words"))
        met = places.join(F.broadcast(table), "w").filter(F.col("win").isNull() | fits & (F.slice("words", start + 1, length) == F.col("win")))
        return met.select("_id", "_loc", "n_words", start.alias("start"), F.when(F.col("win").isNotNull(), length).alias("len"), "its")

    # offsets by token are few: at most one for each place in a window and each length
    offsets = staged(prefix.select("w", F.struct("off", F.size("win").alias("len")).alias("at")).groupBy("w").agg(F.collect_set("at").alias("at")), "decontam-offsets")
    pieces = max(1, -(-offsets.count() // piece_tokens))
    out = rows.select("_id", "_loc", "n_words", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("its"))
    salted = prefix.select("win", "its", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    for k in range(pieces):
        piece = offsets.filter(F.pmod(F.xxhash64("w"), F.lit(pieces)) == k)
        near = places.join(F.broadcast(piece), "w").select("_id", "_loc", "n_words", "words", "pos", F.explode("at").alias("at")).select("*", "at.*")
        near = near.filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
        salt = F.pmod(F.xxhash64("_loc"), F.lit(SALTS)).cast("int")
        near = near.select("_id", "_loc", "n_words", start.alias("start"), "len", F.slice("words", start + 1, F.col("len")).alias("win"), salt.alias("salt"))
        out = out.unionByName(near.join(salted, ["win", "salt"]).select(out.columns))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a window of any item; a document is
    contaminated if its hit words are at least 1 / ``share`` of its words. Null
    texts have no words; null items are no items; repeated documents get a row
    each, null ids too; texts of any length are read whole; other columns, of
    whatever names, aren't read. Empty tables give no hits or no rows. Equal
    items count each by its id.
    """
    return _verdicts(docs, items, id_col, text_col, window, share, broadcast_windows, piece_tokens).drop("_loc", "whole")


def _verdicts(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """``decontaminate`` with each row's locator, ``_loc``, and whether a window of full size occurs, ``whole``."""
    spans = hit_spans(filed(docs, "decontam-input"), items, id_col, text_col, window, broadcast_windows, piece_tokens)
    found = spans.groupBy("_loc").agg(
        F.first("_id").alias("_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("len").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("its"))).alias("items"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long")
    n_hit = F.when(F.size("spans") > 0, covered).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("n_hit", n_hit)
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "_loc",
        F.exists("spans", lambda s: s["len"] >= window).alias("whole"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the rows that hold a passage of an item; same columns.

    A row goes if a window of full size occurs anywhere in it, however long the
    rest is, or if it is ``contaminated``: windows of items shorter than
    ``window`` are common phrases, so those count by their share alone. Rows go
    by locator: another row of the same or no id stays unless it holds a passage
    too. Null and empty texts stay, repeated rows share their fate, an empty
    table gives no rows, without items all stay; extra columns, of whatever
    names, are carried along.
    """
    docs = filed(docs, "decontam-input")
    names = docs.columns
    rows = located(docs, **{f"_c{i}": docs[c] for i, c in enumerate(names)})
    bad = _verdicts(docs, items, id_col, text_col, window, share).filter("whole or contaminated").select("_loc")
    return rows.join(bad, "_loc", "left_anti").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
