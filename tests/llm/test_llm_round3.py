"""Conversation repair, decontamination and vector codes against brute force."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabix.llm import conversation_repair, decontamination, repair_grammar, vector_codes

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, conv string, cost int, symbol string"


def repaired_by_hand(rows):
    """Counts, cost, audit and hash of one conversation's damaged rows (turn, role, text) in order."""
    seen, symbols = set(), []
    out = dict(blank=0, duplicate=0, truncated=0, illegal=0)
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            out[kind] += 1
        symbols.append((role[:1], kind))
    out["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))

    @cache
    def best(i, state, inserted):
        """Cheapest rest from row i; state is the last role kept."""
        nexts = "a" if state == "u" else "u"
        ways = []
        if i == len(symbols):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            role, kind = symbols[i]
            cost, rest = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + rest))
            if kind not in ("blank", "duplicate"):
                stay = 3 * (kind == "truncated")
                cost, rest = best(i + 1, nexts, 0)
                ways.append((cost + 3 + stay, "R" + rest))
                if role == nexts or (role == "s" and state == ""):
                    cost, rest = best(i + 1, role, 0)
                    ways.append((cost + stay, "K" + rest))
        if inserted < 3:
            cost, rest = best(i, nexts, inserted + 1)
            ways.append((cost + 3, "I" + rest))
        return min(ways, default=(10**9, ""))

    out["cost"], out["audit"] = best(0, "", 0)
    state, i, turns = "", 0, []
    for edit in out["audit"]:
        nexts = "a" if state == "u" else "u"
        full = {"a": "assistant", "u": "user"}[nexts]
        if edit == "I":
            turns.append(full + ":")
            state = nexts
            continue
        _, role, text = rows[i]
        i += 1
        if edit == "K":
            turns.append(f"{role}:{text}")
            state = role[0]
        elif edit == "R":
            turns.append(f"{full}:{text}")
            state = nexts
    out["repaired_sha256"] = hashlib.sha256("\n".join(turns).encode()).hexdigest()
    turns = {t for t, *_ in rows if t is not None}
    out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return out


def damaged_by_hand(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in found.items()}


def conversation_rows():
    random.seed(31)
    rows, texts = [], ["Yes.", "No!", "cut off", " ", "What?  ", "Long " * 400 + "text.", "ok\n."]
    for conv in range(120):
        for turn in range(random.randrange(1, 9)):
            role = ("user" if turn % 2 == 0 else "assistant") if random.random() < 0.7 else random.choice(["system", "user", "assistant", "tool", "", None])
            rows.append((conv, turn if random.random() < 0.95 else None, role, random.choice([f"t{turn}{conv}.", *texts, None])))
    rows += [(None, t, "user", "a.") for t in range(5)] + [(500, None, None, None)] + rows[:30]
    rows += [(1000, t, "user" if t % 3 else "assistant", f"m{t % 11}{'.' if t % 5 else ''}") for t in range(160)]
    return rows


@pytest.mark.parametrize("chunk,rules", [(16_384, 512), (7, 512), (50, 0)])
def test_repair_matches_brute_force(spark, chunk, rules):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONVERSATIONS).repartition(3)
    got = conversation_repair.conversation_repair(df, max_rules=rules, chunk_rows=chunk).collect()
    want = damaged_by_hand(rows)
    assert len(got) == len(want)
    for r in got:
        assert r.asDict() == {"conv_id": r.conv_id, **repaired_by_hand(want[r.conv_id])}
    assert conversation_repair.conversation_repair(df.limit(0)).count() == 0


def test_repair_of_hand_cases(spark):
    cases = {
        1: [("user", "a."), ("assistant", "b.")], 2: [("system", "s."), ("user", "a.")], 3: [("assistant", "b.")],
        4: [("user", "a."), ("user", "b.")], 5: [("system", "s.")], 6: [("user", "a."), ("user", "a."), ("assistant", "b")],
    }
    rows = [(c, t, *x) for c, xs in cases.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.illegal, r.gaps) for r in conversation_repair.conversation_repair(df, damage=False).collect()}
    assert got == {1: (0, "KK", 0, 0), 2: (3, "KKI", 0, 0), 3: (3, "IK", 0, 0), 4: (3, "KR", 1, 0), 5: (4, "D", 0, 0), 6: (7, "KDK", 1, 0)}
    far = spark.createDataFrame([(1, -(1 << 62) * 2, "user", "a."), (1, (1 << 62), "user", "b.")], df.schema)
    assert conversation_repair.conversation_repair(far, damage=False).first().gaps == 0


def test_rules_share_matrices_and_ropes():
    random.seed(5)
    strings = ["".join(random.choices(sorted(repair_grammar.TERMINALS), weights=[5, 1, 1] * 4, k=random.randrange(1, 300))) for _ in range(30)]
    rules = ()
    for _ in range(6):
        counts = sum((repair_grammar.pair_counts(repair_grammar.compressed(s, rules)) for s in strings), start=repair_grammar.Counter())
        rules += (counts.most_common(1)[0][0],)
    for s in strings:
        plain, shared = repair_grammar.evaluated(s, ()), repair_grammar.evaluated(s, rules)
        flat = lambda m: {k: (c, "".join(repair_grammar.leaves(rope)), n) for k, (c, rope, n) in m.items()}
        assert flat(plain) == flat(shared) and all(len(rope) == n for _, rope, n in flat(plain).values())
    assert len(repair_grammar.compressed("AAAA" * 64, ("AA", "", ""))) == 32
    assert repair_grammar.pair_counts("AAAAB") == {"AA": 2, "AB": 1}


def test_one_conversation_spans_many_tasks(spark):
    rows = spark.range(4000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id, '.') AS text")
    raw = conversation_repair.damaged(rows)
    whole = raw.select(
        "conv", "turn", "role", F.lit("").alias("head"), F.xxhash64("text").alias("a"), F.lit(0).cast("bigint").alias("b"),
        F.monotonically_increasing_id().alias("tie"), "text")
    chunks = conversation_repair._chunks(conversation_repair._flagged(whole), 16_384)
    assert chunks.groupBy(F.spark_partition_id()).count().count() == 4
    got = conversation_repair.conversation_repair(rows, chunk_rows=100).first()
    want = repaired_by_hand_long(damaged_by_hand([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])[7])
    assert (got.cost, got.audit) == want


def repaired_by_hand_long(rows):
    """Cost and audit of a long conversation, row by row."""
    seen, ways = set(), {"": (0, "")}
    for _, role, text in rows:
        gone = not text.strip() or (role, text) in seen
        cut = 3 * (text.strip()[-1:] not in (".", "!", "?"))
        seen.add((role, text))
        found = {}

        def put(state, cost, audit, found=found):
            found[state] = min(found.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in ways.items():
            at = state
            for n in range(3):
                nexts = "a" if at == "u" else "u"
                put(at, cost + 3 * n + 4, audit + "I" * n + "D")
                if not gone:
                    put(nexts, cost + 3 * n + 3 + cut, audit + "I" * n + "R")
                    if role[0] == nexts:
                        put(nexts, cost + 3 * n + cut, audit + "I" * n + "K")
                at = nexts
        ways = found
    return min((c + {"u": 3}.get(s, 0), a + {"u": "I"}.get(s, "")) for s, (c, a) in ways.items() if s in ("", "a", "u"))


def words_by_hand(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@pytest.mark.parametrize("small", [True, False])
def test_decontamination_matches_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "fits_broadcast", lambda df: False)
    random.seed(12)
    common = ["the", "of", "École", "b2", "x"]
    items = [(i, " ".join(random.choices([*common, *map(str, range(40))], k=random.choice([1, 2, 5, 10, 11, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (None, items[3][1]), (7, "again other words of"), (30, items[4][1]), (200, "The,of-école")]
    docs = []
    for i in range(80):
        parts = random.choices([*common, "y", "z1"], k=random.randrange(0, 40))
        for _ in range(random.randrange(0, 3)):
            at, (_, text) = random.randrange(len(parts) + 1), random.choice(items)
            cut = words_by_hand(text)
            start = random.randrange(0, max(1, len(cut) - 9))
            parts[at:at] = [w.upper() if w.isascii() else w for w in cut[start : start + random.choice([9, 10, 14])]]
        docs.append((i, random.choice([" ", "--", "\n"]).join(parts)))
    docs += [(900, None), (901, ""), (902, "..."), (None, items[0][1]), (5, docs[5][1]), (5, items[1][1]), (903, "of " * 60_000 + items[8][1])]
    df = spark.createDataFrame([(*d, "i", 1) for d in docs], "doc_id bigint, text string, item string, n_hit int")
    bench = spark.createDataFrame([(*b, "c") for b in items], "item_id bigint, text string, content string")
    windows = {}
    for item, text in items:
        w = words_by_hand(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)

    def by_hand(text):
        w, hit, found = words_by_hand(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (mine := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in mine if x is not None}
        return len(w), len(hit), sorted(found), bool(hit)

    got = decontamination.decontaminate(df, bench).collect()
    want = sorted((str(i), *by_hand(t)) for i, t in docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got) == want
    assert sum(r[4] for r in want) > 20 and any(not r[4] for r in want)
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0
    clean = decontamination.decontaminate(df, bench.limit(0))
    assert clean.count() == len(docs) and not clean.filter("contaminated OR n_hit > 0").count()


def test_only_the_rarest_shingle_of_a_window_is_joined(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(20)] + [(50, "h i j k")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "h i j k"), (3, "h i j m")], "item_id bigint, text string")
    contents = decontamination.item_windows(bench, 10).select("content", "length").distinct()
    prefixes, widths = decontamination.prefix_tokens(docs, contents, 3)
    # Of the item's eight shingles one is joined; "i j k" is rarer than "h i j"; the last window has a shingle that is nowhere.
    found = [(r.offset, r.length) for r in prefixes.collect()]
    assert widths == [3] and (1, 4) in found and sorted(n for _, n in found) == [4, 10]


def coded_by_hand(rows, entries, rounds, scale=1024):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = np.array([[int(np.floor(float(x) * scale)) for x in v] for _, v, _ in rows], dtype=object)
    width = whole.shape[1] // 4
    books = [[list(v[p * width : (p + 1) * width]) for v in whole[:entries]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            mine = [v[p * width : (p + 1) * width] for v in whole]
            at = [near(x, books[p])[1] for x in mine]
            for e in set(at):
                members = [x for x, k in zip(mine, at, strict=True) if k == e]
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for (i, _, label), v in zip(rows, whole, strict=True):
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(4)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("size,spread,block", [(8, 0.1, 256), (16, 0.4, 10), (8, 900.0, 10)])
def test_vector_codes_match_brute_force(spark, size, spread, block):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(9, size))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + spread * rng.normal(size=size)], i % 4 or None) for i in range(150)]
    rows += [(300 + i, rows[3][1], 2) for i in range(40)] + [(None, rows[5][1], 1), (4, rows[7][1], 1), (4, rows[7][1], 1)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * size, 1), (1003, [None] * size, 2), (1004, [float("inf")] * size, 2),
           (1005, [1.0] * 4, 2), (1006, [1.0] * 5, 2), (1007, [1e30] * size, 2)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows + odd], "vec_id bigint, embedding array<float>, label int, row int, id string")
    settings = vector_codes.Settings(entries=12, rounds=3)
    coded, books = vector_codes.vector_codes(df.repartition(3), settings, block_rows=block)
    want, hand = coded_by_hand(rows, 12, 3)
    assert [b.tolist() for b in books] == hand
    key = lambda r: (str(r[0]), r[2], r[3], str(r[1]))
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {r.label: r.label_error for r in vector_codes.with_label_error(coded).collect()} == sums
    text = ",".join(str(x) for b in hand for c in b for x in c)
    assert vector_codes.digest_of(books) == hashlib.sha256(text.encode()).hexdigest()
    empty, none = vector_codes.vector_codes(df.limit(0))
    assert none == [] and vector_codes.with_label_error(empty).count() == 0


def test_hilbert_curve_walks_from_neighbour_to_neighbour():
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = vector_codes.hilbert_keys(grid, bits)
        assert len(set(keys)) == len(grid)
        walk = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for _ in range(40):
        values = rng.integers(-50, 50, 4) + rng.integers(-6, 7, (30, 4))
        book = rng.integers(-60, 60, (20, 4))
        near = vector_codes.shortlist(values.min(axis=0), values.max(axis=0), book)
        squared = ((values[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert set(np.flatnonzero((squared == squared.min(axis=1, keepdims=True)).any(axis=0))) <= set(near)
    far = values * (1 << 24)
    at, distance = vector_codes.nearest(far, book * (1 << 24))
    assert (at == squared.argmin(axis=1)).all() and (distance == squared.min(axis=1) << 48).all()
