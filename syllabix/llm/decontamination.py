"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabix.functions.joins import fits_broadcast
from syllabix.llm.common import FILTER_BUCKETS
from syllabix.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TEXT_KEY = ["a", "b"]


def words_of(text: str) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and everything beyond ASCII; none for a missing text."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def text_key(text: str) -> list[Column]:
    """Two independent hashes: equal texts are one text, whatever rows hold them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("second"), whole).alias("b")]


def _joined(left: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a pinned table: broadcast below the measured limits, otherwise a shuffle join that adaptive execution splits."""
    return left.join(F.broadcast(lookup) if fits_broadcast(lookup) else lookup, keys, how)


def item_windows(benchmark: DataFrame, window: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item``, ``length``, ``content`` (words, joined by spaces): windows of ``window`` consecutive words, or the whole shorter item."""
    cut = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("words"))
    cut = cut.withColumn("length", F.least(F.lit(window), F.size("words"))).filter("length > 0")
    starts = cut.select("item", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    return starts.select("item", "length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("content")).distinct()


def shingles(rows: DataFrame, words: str, width: int, *carried: str) -> DataFrame:
    """``at`` (from 0), ``width`` and ``token`` (hash) of every run of ``width`` words, beside the carried columns."""
    each = rows.select(*carried, words, F.posexplode(words).alias("at", "_word")).filter(F.col("at") + width <= F.size(words))
    token = F.xxhash64(F.lit(width), "_word", *[F.get(words, F.col("at") + k) for k in range(1, width)])
    return each.select(*carried, "at", F.lit(width).alias("width"), token.alias("token"))


def prefix_tokens(docs: DataFrame, contents: DataFrame, shingle: int, text: str = "text") -> tuple[DataFrame, list[int]]:
    """The necessary prefix of every window, and the widths of its shingles.

    A window is contained only where all its shingles are, so one of them is a prefix long
    enough, and the rarest is the best: ``token``, ``width``, its ``offset`` in the window and the
    window's ``length``. Rarity is the number of occurrences in all documents, counted for
    the benchmark's tokens.
    """
    cut = contents.withColumn("words", F.split("content", " ")).withColumn("_width", F.least(F.lit(shingle), F.col("length")))
    widths = sorted(r[0] for r in cut.select("_width").distinct().collect())  # at most ``shingle`` numbers
    if not widths:
        return cut.select(F.lit(0).cast("bigint").alias("token"), F.lit(0).alias("width"), F.lit(0).alias("offset"), "length"), []
    tokens = pin(reduce(DataFrame.unionByName, [
        shingles(cut.filter(F.col("_width") == w), "words", w, "content", "length") for w in widths]))
    known = pin(tokens.select("token").distinct())
    small = fits_broadcast(known)
    texts = docs.select(words_of(text).alias("words"))
    counted = []
    for width in widths:
        found = shingles(texts, "words", width).select("token")
        if small:
            found = found.join(F.broadcast(known), "token", "left_semi")
        counted.append(found.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarity = pin(reduce(DataFrame.unionByName, counted).join(known, "token", "left_semi"))
    ranked = tokens.join(rarity, "token", "left").groupBy("content", "length").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", F.col("at").alias("offset"), "width")).alias("rarest"))
    # A window with a shingle that no document has occurs nowhere.
    chosen = ranked.filter("rarest.n > 0").select("rarest.token", "rarest.width", "rarest.offset", "length").distinct()
    return pin(chosen), widths


def candidates(docs: DataFrame, prefixes: DataFrame, widths: list[int], text: str = "text") -> DataFrame:
    """``a``, ``b``, ``start``, ``length``: places where a window's prefix token stands and the window fits into the document."""
    small = fits_broadcast(prefixes)
    rows = docs.select(*text_key(text), words_of(text).alias("words")).withColumn("_size", F.size("words"))
    found = []
    for width in widths:
        tokens = shingles(rows, "words", width, *TEXT_KEY, "_size").drop("width")
        wanted = prefixes.filter(F.col("width") == width).drop("width")
        met = tokens.join(F.broadcast(wanted) if small else wanted, "token").withColumn("start", F.col("at") - F.col("offset"))
        found.append(met.filter("start >= 0 AND start + length <= _size").select(*TEXT_KEY, "start", "length"))
    return reduce(DataFrame.unionByName, found)


def occurrences(docs: DataFrame, benchmark_windows: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """``a``, ``b`` (the text's key), ``start``, ``length``, ``content``: every occurrence of a window, verified word by word."""
    contents = pin(benchmark_windows.select("content", "length").distinct())
    prefixes, widths = prefix_tokens(docs, contents, shingle, text)
    if not widths:
        return docs.select(*text_key(text)).limit(0).select(
            *TEXT_KEY, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("content"))
    places = pin(candidates(docs, prefixes, widths, text).groupBy(*TEXT_KEY).agg(F.collect_set(F.struct("start", "length")).alias("spans")))
    bucket = F.pmod(F.col("a"), F.lit(FILTER_BUCKETS)).cast("bigint").alias("bucket")
    wanted = F.broadcast(places.select(bucket).distinct())  # at most FILTER_BUCKETS numbers
    texts = (
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), *text_key(text)).select("*", bucket)
        .join(wanted, "bucket", "left_semi").groupBy(*TEXT_KEY).agg(F.first("text").alias("text"))
    )
    cut = texts.join(places, TEXT_KEY).select(*TEXT_KEY, words_of("text").alias("words"), "spans")
    span = F.explode("spans").alias("span")
    read = cut.select(*TEXT_KEY, "words", span).select(
        *TEXT_KEY, "span.start", "span.length",
        F.array_join(F.slice("words", F.col("span.start") + 1, F.col("span.length")), " ").alias("content"))
    return _joined(read, contents.select("content"), ["content"], "left_semi").select(*TEXT_KEY, "start", "length", "content")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3,
    text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted strings), ``contaminated`` of every document row.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; document
    words inside any occurrence of a window are hit. The windows that occur are found by a
    set join: shingles of ``shingle`` words (fewer for shorter windows) are ordered by their
    rarity in all documents, only the rarest of a window is joined, the window must fit
    into the document around it, and the words of every place left are compared whole.

    Only narrow rows (hashes and positions) meet the join. It is a broadcast below the
    limits measured on the prefixes and a shuffle join above them. Texts of documents with
    candidates are read once more, once per distinct text; others never move.

    A missing or empty text has no words and no hits, such an item no windows. Repeated
    rows get the same answer, missing identifiers too. Items with the same identifier
    count once; one without identifier makes hits and contaminates, but is not listed.
    Other columns are not read. An empty benchmark hits nothing, no documents give no rows.
    """
    windows = pin(item_windows(benchmark, window, item_text, item_id))
    found = pin(occurrences(docs, windows, shingle, text))
    # Sorted by their start, spans cover what lies beyond the last end so far.
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "length"))), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda total, s: F.struct(
            (total["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(total["end"], s["start"]))).alias("n"),
            F.greatest(total["end"], s["start"] + s["length"]).alias("end")),
        lambda total: total["n"])
    hit = found.groupBy(*TEXT_KEY).agg(covered.alias("n_hit"))
    items = (
        _joined(found.select(*TEXT_KEY, "content").distinct(), windows.select("content", "item").filter("item IS NOT NULL"), ["content"])
        .groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = pin(hit.join(items, TEXT_KEY, "left"))
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), "")).cast("bigint")
    rows = docs.select(F.col(doc_id).alias("_id"), n_words.alias("n_words"), *text_key(text))
    return _joined(rows, hits, TEXT_KEY, "left").select(
        F.col("_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
