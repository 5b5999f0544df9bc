"""Line deduplication by prefix doubling over line sequences, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syllabix.llm.common import FILTER_BUCKETS, shuffle_partitions
from syllabix.session import pin

SPACE = " \t\n\r\f\x0b"
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc", "row"]


def _keys(text: str, doc_id: str) -> list[Column]:
    """A document is its identifier and a hash of its text, so repeated rows are one document."""
    return [
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"),
    ]


def line_sequences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lines with a word, numbered ``p`` within their document: ``doc``, ``row``, ``p``, ``line``, ``words``, ``a``, ``b``.

    ``line`` is the number among all lines, ``a`` and ``b`` are two independent hashes of
    the line without surrounding white space: together the line's ID.
    """
    cut = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
        lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(SPACE)).alias("content")))
    rows = docs.select(*_keys(text, doc_id), F.filter(cut, lambda x: x["content"] != "").alias("lines"))
    lines = rows.select(*DOC, F.posexplode("lines").alias("p", "found"))
    content = F.col("found.content")
    return lines.select(
        *DOC, "p", F.col("found.line").alias("line"), F.regexp_count(content, F.lit(WORD)).alias("words"),
        F.xxhash64(content).alias("a"), F.xxhash64(F.lit("second"), content).alias("b"),
    )


def _ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """``doc``, ``row``, ``p`` and ``rank`` of the rows whose ``key`` occurs more than once.

    Rows are sorted over all tasks by key and position (a range partitioning, so a
    frequent key spans many tasks), numbered in that order, and a key's rank is its first
    number: the place of its interval in the suffix array.
    """
    order = [*key, *DOC, "p"]
    parts = shuffle_partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = pin(ordered.withColumn("_at", F.monotonically_increasing_id()))
    intervals = pin(
        placed.groupBy(*key).agg(F.min("_at").alias("rank"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    return pin(placed.join(intervals, key).select(*DOC, "p", "rank"))


def suffix_ranks(single: DataFrame, levels: int) -> list[DataFrame]:
    """From the ranks of single lines, per level k the ``rank`` of the 2**k lines from every position, where that run occurs more than once.

    Level k pairs the ranks of level k-1 at a position and 2**(k-1) lines further on
    (prefix doubling). Runs with equal rank are equal, ranks sort as the runs do, and the
    positions of one rank are an interval whose common prefix has at least 2**k lines.
    Positions drop out as soon as their run is unique.
    """
    found = [single]
    document = Window.partitionBy(*DOC).orderBy("p")
    for level in range(1, levels):
        step = 1 << (level - 1)
        ahead = found[-1].withColumn("_p", F.lead("p", step).over(document)).withColumn("second", F.lead("rank", step).over(document))
        pairs = ahead.filter(F.col("_p") == F.col("p") + step).select(*DOC, "p", F.col("rank").alias("first"), "second")
        found.append(_ranked(pairs, ["first", "second"]))
    return found


def _shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of repeated lines with ``min_words`` words from, and up to, every line: ``s`` and ``size``.

    Every longer run with as many words is a union of these.
    """
    document = Window.partitionBy(*DOC).orderBy("p")
    segment = [*DOC, "segment"]
    rows = repeated.withColumn("segment", F.col("p") - F.row_number().over(document))
    upto = Window.partitionBy(*segment).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    whole = Window.partitionBy(*segment)
    later = whole.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)
    sooner = whole.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    rows = (
        rows.withColumn("first", F.min("p").over(whole)).withColumn("last", F.max("p").over(whole))
        .withColumn("total", F.max("upto").over(whole))
        .withColumn("next", F.min("p").over(later)).withColumn("prior", F.max("p").over(sooner))
    )
    end = F.when(F.col("next").isNotNull(), F.col("next") - 1).when(F.col("total") - F.col("before") >= min_words, F.col("last"))
    start = F.when(F.col("prior").isNotNull(), F.col("prior") + 1).when(F.col("upto") >= min_words, F.col("first"))
    runs = F.array(
        F.struct(F.col("p").alias("s"), (end - F.col("p") + 1).alias("size")),
        F.struct(start.alias("s"), (F.col("p") - start + 1).alias("size")))
    return rows.select(*DOC, F.explode(runs).alias("run")).select(*DOC, "run.s", "run.size").filter("size > 0").distinct()


def repeated_lines(docs: DataFrame, min_words: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lines that belong to a later copy of a run with at least ``min_words`` words: ``doc``, ``row``, ``line``."""
    lines = pin(line_sequences(docs, text, doc_id).dropDuplicates([*DOC, "p"]))
    single = _ranked(lines.select(*DOC, "p", "a", "b"), ["a", "b"])
    repeated = lines.select(*DOC, "p", "words").join(single.select(*DOC, "p"), [*DOC, "p"])
    runs = pin(_shortest_runs(repeated, min_words))
    longest = runs.agg(F.max("size")).first()[0] or 1
    ranks = suffix_ranks(single, int(longest).bit_length())
    named = []
    for level, rank in enumerate(ranks):
        width = 1 << level
        mine = runs.filter(F.col("size").between(width, 2 * width - 1))
        head = rank.select(*DOC, F.col("p").alias("s"), F.col("rank").alias("x"))
        tail = rank.select(*DOC, F.col("p").alias("t"), F.col("rank").alias("y"))
        # A run of another length is known by its first and its last 2**level lines.
        named.append(
            mine.join(head, [*DOC, "s"]).withColumn("t", F.col("s") + F.col("size") - width).join(tail, [*DOC, "t"])
            .select(*DOC, "s", "size", "x", "y"))
    named = pin(reduce(DataFrame.unionByName, named))
    place = F.struct(*DOC, "s")
    firsts = pin(
        named.groupBy("size", "x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    copies = named.join(firsts, ["size", "x", "y"]).filter(place > F.col("first"))
    covered = copies.select(*DOC, F.explode(F.sequence("s", F.col("s") + F.col("size") - 1)).alias("p")).distinct()
    return covered.join(lines.select(*DOC, "p", "line"), [*DOC, "p"]).select(*DOC, "line")


def repeated_runs(docs: DataFrame, min_words: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Maximal stretches of removed lines: ``doc``, ``row``, ``start``, ``n_lines``."""
    found = repeated_lines(docs, min_words, text, doc_id)
    stretch = F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line"))
    return found.withColumn("_stretch", stretch).groupBy(*DOC, "_stretch").agg(
        F.min("line").alias("start"), F.count(F.lit(1)).alias("n_lines")).drop("_stretch")


def line_dedup(docs: DataFrame, min_words: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``text`` without later copies of repeated line runs, ``n_removed`` lines.

    Lines are compared without surrounding white space and blank lines are skipped (and
    stay). A line goes if it lies in a run of lines with at least ``min_words`` words that
    also occurs earlier: at a smaller identifier, or before it in the same document. The
    first copy of a run stays. Runs are found by prefix doubling: as many levels of
    suffix ranks as the longest of the shortest such runs needs, at most log2(min_words)
    whatever the documents, because every longer run is a union of those.

    A missing text counts as empty; rows repeated with identifier and text are one
    document and stay as many rows; a missing identifier sorts first. Identifiers are
    whole numbers. Other columns are not read; an empty table gives no rows. Texts are
    not shuffled, except those of documents that lose lines.
    """
    removed = pin(
        repeated_lines(docs, min_words, text, doc_id).groupBy(*DOC).agg(F.collect_set("line").alias("gone")))
    whole = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_keys(text, doc_id))
    bucket = F.pmod(F.xxhash64(*DOC), F.lit(FILTER_BUCKETS)).cast("bigint").alias("bucket")
    # At most FILTER_BUCKETS numbers.
    hits = F.broadcast(removed.select(bucket).distinct().withColumn("hit", F.lit(True)))
    marked = whole.select("*", bucket).join(hits, "bucket", "left")
    clear = marked.filter("hit IS NULL").select("id", "text", F.lit(0).alias("n_removed"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    unclear = marked.filter("hit").join(removed, DOC, "left").select(
        "id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    return clear.unionByName(unclear).select(F.col("id").alias(doc_id), F.col("text").alias(text), "n_removed")
