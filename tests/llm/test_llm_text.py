"""Token counts, packing, quality, toxicity, exact and line deduplication."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from syllabix.llm import exact_dedup, line_dedup, packing, quality, token_counts, toxicity
from syllabix.llm.bpe import identifiers, lengths, merged_length
from syllabix.llm.common import drop_documents, fold
from syllabix.llm.training import Sample, labelled_sample

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "Don't I'LL", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ ΟΔΟΣ İK ß", "漢字かな 한글", "🙂👍🏽 ok", "½² ª 12a3", "a\x1cb\x85c\xa0d",
       "KƩ ƁA", "a" * 3000, "é ​﻿", "\x00\x01", "!?" * 500]


def documents(spark, rows):
    """Rows of identifier and text beside columns whose names clash with the operators' own."""
    full = [(i, t, "piece", 7, "score") for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, id string, length int, kept string")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_tokens_are_the_librarys():
    library = Tokenizer.from_file(VOCABULARY)
    random.seed(2)
    texts = ODD + ["".join(chr(random.choice([random.randrange(1, 592), random.randrange(1, 0x3000), 32])) for _ in range(30)) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert lengths(VOCABULARY).of(text) == len(ids), text
        assert identifiers(VOCABULARY).of(text) == np.array(ids, "<u4").tobytes(), text


def test_merging_takes_the_lowest_rank_first_and_the_leftmost():
    ranks = {("a", "b"): 1, ("b", "c</w>"): 0, ("a", "a"): 2}
    assert merged_length("abc", ranks) == 2 and merged_length("aaa", ranks) == 2 and merged_length("aaab", ranks) == 3


def test_token_counts(spark):
    df = documents(spark, [*enumerate(ODD), (99, None), (None, "a b"), (5, "again"), (5, "again")])
    got = token_counts.token_counts(df, VOCABULARY, limit=3)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(ODD) + 4
    rows = collected(got)
    assert rows[99].n_tokens == 0 and rows[None].n_tokens == 2 and rows[14].n_bytes == 1000 and not rows[0].over_limit
    assert token_counts.token_counts(df.limit(0), VOCABULARY).count() == 0


def test_packing_round_trip(spark):
    random.seed(4)
    rows = [(i, " ".join(random.choices(["ab", "Cde", "fgh!"], k=random.choice([0, 3, 40, 90, 700])))) for i in range(60)]
    df = documents(spark, [*rows, (None, "x"), (3, rows[3][1]), (200, None)])
    capacity = packing.Capacity(tokens=128)
    got = packing.pack_documents(df, VOCABULARY, capacity, keep_ids=True).collect()
    library, parts, bins = Tokenizer.from_file(VOCABULARY), {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        parts.setdefault(r.doc_id, {})[r.piece] = r
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in [*rows, (200, "")]:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        pieces = [parts[i][k] for k in range(len(parts[i]))]
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in pieces] == list(range(0, len(ids), 128)) and all(p.length == 128 for p in pieces[:-1])
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 128
    assert len(bins) <= -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack_documents(df.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    sizes = np.random.default_rng(1).integers(1, 60, 300)
    capacity = packing.Capacity(tokens=100, documents=4, attention=4000, weights=(1.0, 0.5, 0.5), rule=rule)
    bins, offsets = packing.best_fit(sizes, capacity)
    for b in set(bins.tolist()):
        mine = sizes[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 4 and (mine**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(mine[np.argsort(offsets[bins == b])])[:-1]]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([90]), capacity)


def test_exact_dedup(spark):
    long = "w " * 300
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "c"), (7, long + "x"), (8, long + "y"), (9, long + "x"), (None, "a"), (None, "z"), (3, "b")]
    got = exact_dedup.exact_dedup(documents(spark, rows), digest_all=True).collect()
    assert len(got) == len(rows)
    answer = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None}
    assert answer == {1: (2, 3, False), 2: (2, 3, True), 3: (3, 2, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True),
                      7: (9, 2, False), 8: (8, 1, True), 9: (9, 2, True)}
    assert sorted((r.keep_id, r.kept) for r in got if r.doc_id is None and r.keep_id) == [(2, False)]
    assert {r.text_sha256 for r in got if r.doc_id == 8} == {hashlib.sha256((long + "y").encode()).hexdigest()}
    plain = exact_dedup.exact_dedup(documents(spark, rows))
    assert plain.filter("text_sha256 IS NULL AND group_size > 1").count() == 0
    assert exact_dedup.exact_dedup(documents(spark, rows).limit(0)).count() == 0


def removed_by_hand(rows, min_words):
    """Lines inside any run with enough words that occurs earlier, by looking at all runs."""
    sequences = {}
    for i, text in sorted(rows):
        lines = [(n, x.strip(line_dedup.SPACE)) for n, x in enumerate((text or "").split("\n"))]
        sequences[i] = [(n, x, len(x.split())) for n, x in lines if x]
    seen, gone = {}, set()
    for i, lines in sequences.items():
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x, _ in lines[a:b])
                if sum(w for *_, w in lines[a:b]) >= min_words and seen.setdefault(run, (i, a)) < (i, a):
                    gone |= {(i, n) for n, *_ in lines[a:b]}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_all_runs(spark, seed):
    random.seed(seed)
    pool = ["one two three", "a", "b c", "long line of six words here", "x y", "", " b c ", "solo"]
    rows = [(i, "\n".join(random.choices(pool, k=random.randrange(0, 14)))) for i in range(40)] + [(77, None), (78, "a\na\na\na\na\na\na\na")]
    got = line_dedup.line_dedup(documents(spark, rows), 5)
    assert got.columns == ["doc_id", "text", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == removed_by_hand(rows, 5)


def test_line_dedup_edge_rows(spark):
    rows = [(1, "p q r s t u\nz"), (2, "p q r s t u\nz"), (2, "p q r s t u\nz"), (None, "p q r s t u")]
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in line_dedup.line_dedup(documents(spark, rows), 5).collect())
    assert got == [("1", "z", 1), ("2", "", 2), ("2", "", 2), ("None", "p q r s t u", 0)]
    assert line_dedup.line_dedup(documents(spark, rows).limit(0), 5).count() == 0
    runs = line_dedup.repeated_runs(documents(spark, rows), 5).collect()
    assert sorted((r.doc, r.start, r.n_lines) for r in runs) == [(1, 0, 1), (2, 0, 2)]


def labelled(spark, column, good, bad, n=120):
    random.seed(5)
    words = ["river", "stone", "walks", "under", "bright", "morning", "paper", "green"]
    texts = [(i, ". ".join(" ".join(random.choices(words, k=6)) for _ in range(5)) + (bad if i % 2 else good)) for i in range(n)]
    labels = spark.createDataFrame([(i, int((i % 2 == 1) == (column == "toxic"))) for i, _ in texts], f"doc_id bigint, {column} int")
    return documents(spark, [*texts, (1000, None), (1001, ""), (None, "river stone"), (1002, "word " * 50_000)]), labels


def test_toxicity_finds_documents_and_sentences(spark):
    df, labels = labelled(spark, "toxic", ". fine stone", ". you utter scoundrel there. Bright paper")
    held_out = fold("doc_id", 4) == 2
    settings = toxicity.Settings(per_class=100)
    rows = toxicity.toxicity(df, df, labels, ~held_out, settings).withColumn("held_out", held_out).collect()
    assert len(rows) == 124
    for r in rows:
        if r.doc_id is not None and r.doc_id < 1000:
            assert (r.score >= 0.3) == (r.doc_id % 2 == 1) and len(r.sentences) == r.doc_id % 2
        elif r.doc_id in (1000, 1001):
            assert r.score == 0 and r.sentences == []
    assert toxicity.toxicity(df.limit(0), df, labels, ~held_out, settings).count() == 0
    sample = labelled_sample(df, labels, "toxic", ~held_out, 10, 1000)
    assert len(sample.texts) == 20 and sum(sample.labels) == 10
    kept = toxicity.reject_toxic(df, toxicity.train(sample, settings))
    assert kept.columns == df.columns and kept.filter("doc_id % 2 = 1 AND doc_id < 1000").count() == 0
    assert {r.doc_id for r in kept.collect()} >= {0, 2, 1000, 1001, None}


def test_toxicity_without_evidence():
    assert toxicity.score_text("Any text. At all.", toxicity.WordWeights(toxicity.train(Sample([], [], 0.0), toxicity.Settings())), 0.3)[0] < 1e-9
    assert toxicity.train(Sample(["", " "], [0, 1], 0.5), toxicity.Settings()).weights == {}


def test_quality_learns_marks_repeats_and_shouting(spark):
    df, labels = labelled(spark, "quality", ". fine stone", " STOP!! BUY!! junk junk junk junk junk&&& $$$")
    held_out = fold("doc_id", 3) == 1
    rows = quality.quality_classifier(df, labels, ~held_out, quality.Settings(per_class=100, epochs=20)).collect()
    assert len(rows) == 124 and all(0 <= r.score <= 1 for r in rows)
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows if r.doc_id is not None and r.doc_id < 1000)
    assert quality.quality_classifier(df.limit(0), labels, ~held_out, quality.Settings(epochs=1)).count() == 0


def test_drop_documents_keeps_rows_without_identifier(spark):
    df = documents(spark, [(1, "a"), (2, "b"), (2, "c"), (None, "d")])
    gone = spark.createDataFrame([(2,), (9,), (None,)], "doc_id bigint")
    assert sorted(str(r.doc_id) for r in drop_documents(df, gone).collect()) == ["1", "None"]


def least_bins(sizes, capacity):
    """Least number of bins for a few pieces, by trying every assignment."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in bins:
            if sum(b) + sizes[i] <= capacity.tokens and len(b) < capacity.documents and sum(x * x for x in b) + sizes[i] ** 2 <= capacity.attention:
                b.append(sizes[i])
                place(i + 1, bins)
                b.pop()
        bins.append([sizes[i]])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_near_the_least_number_of_bins(rule):
    rng, extra = np.random.default_rng(11), 0
    for _ in range(40):
        sizes = rng.integers(5, 70, 10)
        capacity = packing.Capacity(tokens=100, documents=int(rng.integers(2, 5)), attention=int(rng.integers(5000, 10000)), rule=rule)
        used, least = len(set(packing.best_fit(sizes, capacity)[0].tolist())), least_bins(sizes.tolist(), capacity)
        assert least <= used <= least + 1
        extra += used - least
    assert extra <= 8


def test_equal_sizes_and_ties_fill_bins():
    bins, offsets = packing.best_fit(np.full(12, 25), packing.Capacity(tokens=100))
    assert sorted(np.bincount(bins)) == [4, 4, 4] and sorted(offsets.tolist()) == [0] * 3 + [25] * 3 + [50] * 3 + [75] * 3


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20_000


def test_very_long_texts_pass_whole(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + "end"), (4, "short\n" + LONG), (5, None)]
    kept = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(documents(spark, rows)).collect()}
    assert kept == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    lines = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, rows), 10).collect()}
    assert lines == {1: LONG, 2: "", 3: LONG + "end", 4: "short", 5: ""}
    packed = packing.pack_documents(documents(spark, rows[:2]), VOCABULARY).collect()
    library = Tokenizer.from_file(VOCABULARY)
    assert sum(r.length for r in packed) == 2 * (len(library.encode(LONG, add_special_tokens=False).ids) + 1)
    assert all(r.length == 4096 for r in packed if r.piece < max(p.piece for p in packed))


def test_classifiers_take_repeated_rows_and_empty_labels(spark):
    rows = [(i, f"text number {i % 3}") for i in range(30)] + [(3, "text number 0")] * 4 + [(None, None)] * 3
    df = documents(spark, rows)
    for module, column in ((quality, "quality"), (toxicity, "toxic")):
        none = spark.createDataFrame([], f"doc_id bigint, {column} int")
        some = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2 + [(3, None), (None, 1)], f"doc_id bigint, {column} int")
        for labels in (none, some):
            if module is quality:
                got = quality.quality_classifier(df, labels, fold("doc_id", 3) != 1, quality.Settings(epochs=1))
            else:
                got = toxicity.toxicity(df, df, labels, fold("doc_id", 4) != 2)
            found = [(r.doc_id, r.score) for r in got.collect()]
            assert len(found) == len(rows) and all(0 <= s <= 1 for _, s in found)
            assert len({s for i, s in found if i in (0, 3)}) == 1 and len({s for i, s in found if i is None}) == 1


def test_held_out_is_known_without_identifier(spark):
    from syllabix.llm.queries import held_out_fold
    df = spark.createDataFrame([(1,), (None,)], "doc_id bigint").select("doc_id", held_out_fold(3, 1).alias("h"))
    assert {r.doc_id: r.h for r in df.collect()}[None] is False


def test_long_words_are_not_remembered():
    words = toxicity.WordWeights(toxicity.Model({"a" * 1000: 2.0}, -1.0))
    assert words["a" * 1000] == 2.0 and words["short"] == 0.0 and list(words) == ["short"]
