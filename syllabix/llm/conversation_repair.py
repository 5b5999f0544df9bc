"""Repair of conversation structure by a grammar-compressed dynamic program."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from syllabix.functions.joins import lookup_join, null_safe_join
from syllabix.llm.common import map_batches, shuffle_partitions
from syllabix.llm.repair_grammar import (
    DELETED, LEGAL, OK, ROLES, SYMBOLS, START, TRUNCATED, Repairer, best_path, compressed, costs_and_ranks, ending,
    evaluated, leaves, pair_counts,
)
from syllabix.session import pin, ship_package

SPACE = " \t\n\r\f\x0b"
# Order of a conversation's rows: by turn, missing first; rows of one turn by role and text (first characters, then hashes).
PLACE = ["turn", "role", "head", "a", "b", "tie"]
HEAD = 64
# Rows of a conversation that are one string of symbols, and bounds of the grammar.
CHUNK_ROWS, MAX_RULES, MAX_ROUNDS = 16_384, 512, 12
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` after the fixed damage: by crc32 of ``conv:turn`` modulo 20 a row is dropped (0), emptied (1),
    loses its sentence ends (2), comes twice (3) or becomes a user's (4). Missing values are one space.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in (conv_id, turn)])
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    rows = rows.filter("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def _flagged(rows: DataFrame) -> DataFrame:
    """Adds ``blank``, ``duplicate`` and ``truncated`` (a row's first fault) and ``symbol``; drops ``text``.

    The first row of a role and text is found by an aggregate that is summed before the
    shuffle, and joined back only for those that occur more than once.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select(
        "conv", *PLACE, (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"))
    same = ["conv", "role", "a", "b"]
    firsts = narrow.groupBy(*same).agg(
        F.min(F.struct("turn", "tie")).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    known = lookup_join(narrow, firsts, same)
    later = F.col("first").isNotNull() & (F.col("tie") != F.col("first.tie"))
    known = known.withColumn("duplicate", ~F.col("blank") & later)
    known = known.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank") | F.col("duplicate"), DELETED).when(F.col("truncated"), TRUNCATED).otherwise(OK)
    return known.select("conv", *PLACE, "blank", "duplicate", "truncated", F.char(F.lit(ord("A")) + 3 * _place(initial) + fault).alias("symbol"))


def _place(initial: Column) -> Column:
    out = F.lit(len(ROLES) - 1)
    for i, role in enumerate(ROLES[:3]):
        out = F.when(initial == role, i).otherwise(out)
    return out


INITIALS = {symbol: role for (role, _), symbol in SYMBOLS.items()}


def _illegal(pairs: Iterator[tuple[str, str]]) -> int:
    return sum(a + b not in LEGAL for a, b in pairs)


def _chunks(flagged: DataFrame, chunk_rows: int) -> DataFrame:
    """Strings of at most ``chunk_rows`` symbols with the place of their first row, and their adjacent roles that are not legal.

    Rows are range-partitioned by conversation and place, so one conversation may span any
    number of tasks; a task holds one batch and one unfinished string.
    """
    keys = [F.col(c) for c in ("conv", *PLACE)]
    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv", *PLACE)) + ", symbols string, illegal bigint"
    target = to_arrow_schema(flagged.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict | None = None
        symbols: list[str] = []

        def done() -> dict:
            whole = "".join(symbols)
            initials = [INITIALS[s] for s in whole]
            return first | {"symbols": whole, "illegal": _illegal(zip(initials, initials[1:], strict=False))}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                symbol = row.pop("symbol")
                if first is not None and (row["conv"] != first["conv"] or len(symbols) == chunk_rows):
                    out.append(done())
                    first = None
                if first is None:
                    first, symbols = row, []
                symbols.append(symbol)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if first is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=target)

    ordered = flagged.select(*keys, "symbol").repartitionByRange(shuffle_partitions(flagged.sparkSession), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)


def learned_rules(chunks: DataFrame, max_rules: int = MAX_RULES, max_rounds: int = MAX_ROUNDS) -> tuple[str, ...]:
    """Re-Pair over all conversations: the pairs that the rules stand for, in their order.

    In every round the adjacent pairs of all different strings are counted with their
    conversations' numbers; the most frequent ones that share no symbol with each other
    become rules, because replacing one leaves the counts of the others as they are. The
    driver sees at most ``max_rules`` pairs a round. The bounds limit how far strings are
    shortened, not what they evaluate to.
    """
    strings = pin(chunks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")))
    rules: tuple[str, ...] = ()
    for _ in range(max_rounds):
        def counted(columns: dict[str, list], rules: tuple[str, ...]) -> dict[str, list]:
            counts: Counter[str] = Counter()
            for symbols, n in zip(columns["symbols"], columns["n"], strict=True):
                for pair, k in pair_counts(compressed(symbols, rules)).items():
                    counts[pair] += n * k
            return {"pair": list(counts), "n": list(counts.values())}

        found = map_batches(strings, counted, "pair string, n bigint", rules).groupBy("pair").agg(F.sum("n").alias("n"))
        top = found.filter("n > 1").orderBy(F.desc("n"), "pair").limit(max_rules).collect()
        used: set[str] = set()
        chosen = []
        for row in top:
            if not used & set(row["pair"]):
                used |= set(row["pair"])
                chosen.append(row["pair"])
        rules += tuple(chosen[: max_rules - len(rules)])
        if not chosen or len(rules) == max_rules:
            break
    return rules


def _measured(columns: dict[str, list], rules: tuple[str, ...]) -> dict[str, list]:
    found = [costs_and_ranks(evaluated(s, rules)) for s in columns["symbols"]]
    kept = {c: v for c, v in columns.items() if c != "symbols"}
    return kept | {
        "costs": [c for c, _ in found], "ranks": [r for _, r in found],
        "first": [INITIALS[s[0]] for s in columns["symbols"]], "last": [INITIALS[s[-1]] for s in columns["symbols"]],
    }


def _paths(measured: DataFrame) -> DataFrame:
    """Per string the states ``before`` and ``after`` it on its conversation's cheapest way, the conversation's ``cost`` with its first
    string, and ``illegal`` with the border to the string before. A conversation is 32 small numbers per string here.
    """
    kinds = {f.name: f.dataType.simpleString() for f in measured.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv", *PLACE)) + ", before int, after int, final boolean, cost bigint, illegal bigint"
    target = to_arrow_schema(measured.sparkSession.createDataFrame([], schema).schema)

    def solved(rows: list[dict]) -> list[dict]:
        states, cost = best_path([(r["costs"], r["ranks"]) for r in rows])
        out = []
        for i, (row, before, after) in enumerate(zip(rows, [START, *states], states, strict=False)):
            border = i and _illegal(iter([(rows[i - 1]["last"], row["first"])]))
            out.append({c: row[c] for c in ("conv", *PLACE)} | {
                "before": before, "after": after, "final": i == len(rows) - 1, "cost": 0 if i else cost, "illegal": row["illegal"] + border})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if mine and row["conv"] != mine[0]["conv"]:
                    out += solved(mine)
                    mine = []
                mine.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if mine:
            yield pa.RecordBatch.from_pylist(solved(mine), schema=target)

    dealt = measured.repartition(shuffle_partitions(measured.sparkSession), "conv").sortWithinPartitions("conv", *PLACE)
    return dealt.mapInArrow(run, schema)


def _audits(columns: dict[str, list], rules: tuple[str, ...]) -> dict[str, list]:
    out = []
    for symbols, before, after, final in zip(*(columns[c] for c in ("symbols", "before", "after", "final")), strict=True):
        audit = "".join(leaves(evaluated(symbols, rules)[before, after][1]))
        out.append(audit + ending(after)[1] if final else audit)
    return {c: columns[c] for c in ("conv", *PLACE, "cost", "illegal")} | {"audit": out}


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """SHA-256 of every repaired conversation.

    A hash runs over its text in order, so the rows of a conversation stream through one
    task, each string's edits ahead of its first row; the task holds one batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"conv {kinds['conv']}, repaired_sha256 string"
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, repairer, empty = None, None, Repairer(), True

        def write(turns: Iterator[str]) -> None:
            nonlocal empty
            for turn in turns:
                digest.update(("" if empty else "\n").encode() + turn.encode())
                empty = False

        for batch in batches:
            out = []
            for now, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "role", "text")), strict=True):
                if digest is None or now != conv:
                    if digest is not None:
                        write(repairer.inserted())
                        out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest, repairer, empty = now, hashlib.sha256(), Repairer(), True
                write(repairer.load(edits) if edits is not None else repairer.row(role, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if digest is not None:
            write(repairer.inserted())
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema=target)

    heads = audits.select("conv", *PLACE, F.lit(0).alias("_kind"), F.col("audit").alias("edits"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.select("conv", *PLACE, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("edits"), "text"))
    dealt = both.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", *PLACE, "_kind")
    return dealt.select("conv", "edits", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame, max_rules: int = MAX_RULES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` of every conversation in ``rows``.

    ``rows`` has ``conv``, ``turn``, ``role`` and ``text`` (role and text not null). The edits and their costs are
    those of ``conversation_repair``. Every row becomes a symbol of role and fault; the
    strings of all conversations share one Re-Pair grammar. Each rule has one min-plus
    matrix (state before and after: cost and audit rope), made bottom-up once per worker,
    and a string is the product of its symbols' matrices. A conversation longer than
    ``chunk_rows`` is several strings in several tasks, joined by their costs.
    """
    ship_package(rows.sparkSession)
    whole = pin(rows.select(
        "conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("text").alias("a"),
        F.xxhash64(F.lit("second"), "text").alias("b"), F.monotonically_increasing_id().alias("tie"), "text"))
    flagged = pin(_flagged(whole))
    counts = flagged.groupBy("conv").agg(
        F.coalesce(F.try_subtract(F.max("turn"), F.min("turn")) + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    chunks = pin(_chunks(flagged, chunk_rows))
    rules = learned_rules(chunks, max_rules)
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    keys = ", ".join(f"{c} {kinds[c]}" for c in ("conv", *PLACE))
    measured = map_batches(
        chunks, _measured, f"{keys}, illegal bigint, costs array<int>, ranks array<int>, first string, last string", rules)
    paths = _paths(measured)
    # ``tie`` is a row's own number, so it names a string.
    met = chunks.select("conv", *PLACE, "symbols").join(paths.drop("conv", *PLACE[:-1]), "tie")
    audits = pin(map_batches(met, _audits, f"{keys}, cost bigint, illegal bigint, audit string", rules))
    parts = F.sort_array(F.collect_list(F.struct(*PLACE, "audit")))
    solved = audits.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    return null_safe_join(null_safe_join(counts, solved, ["conv"]), _repaired(whole, audits), ["conv"])


def conversation_repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    damage: bool = True, max_rules: int = MAX_RULES, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Cheapest structural repair of every conversation, one row each.

    Rows are taken by turn (missing first; rows of one turn by role, then text). A row's
    first fault is blank (no visible character), duplicate (role and text seen earlier in
    the conversation) or truncated (its last visible character ends no sentence). Edits: keep
    0, give the role user or assistant 3, delete 4 (needed for blank and duplicate rows),
    insert an empty user or assistant turn 3; a truncated row that stays costs 3 more. The
    role initials must become ``(s?(ua)+)?``; ``audit`` has the initials of the cheapest edits,
    the ASCII-least of equal ones. ``illegal`` counts adjacent role initials other than su, ua and
    au, ``gaps`` missing turn numbers. ``damage`` applies the fixed damage of ``damaged`` first.

    Missing roles and texts are one space (which is blank), missing turns sort first and
    make no gaps, a missing conversation is one conversation. Without rows after damage all
    counts are 0, the audit is empty and the hash that of nothing. Repeated rows are
    duplicates. Turns too far apart for a long give no gaps. Other columns are not read; an empty table gives no rows.
    """
    blank = F.lit(" ")
    rows = damaged(conversations, conv_id, turn, role, text) if damage else conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    every = conversations.select(F.col(conv_id).alias("conv")).distinct()
    zero = F.lit(0).cast("bigint")
    return null_safe_join(every, repair(rows, max_rules, chunk_rows), ["conv"], "left").select(
        F.col("conv").alias(conv_id), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
