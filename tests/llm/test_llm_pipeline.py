"""The corpus pipeline against a small brute-force one."""

import random
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from syllabix.llm import toxicity
from syllabix.llm.common import fold
from syllabix.llm.oracle import mixing
from syllabix.llm.queries import TREE_WEIGHTS, WORD_VOCABULARY
from syllabix.llm.training import labelled_sample
from syllabix.session import release_pinned

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    """Clean, toxic, copied and nearly copied documents, repeated rows and rows without identifier."""
    random.seed(77)
    vocabulary = ["".join(random.choices("abcdefghij", k=5)) for _ in range(900)]
    rows, labels = [], []
    for i in range(240):
        words = random.choices(vocabulary, k=random.randrange(20, 90))
        toxic = i % 6 == 0
        text = ". ".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8)) + (". you vile scoundrel there." if toxic else ".")
        rows.append((i, text, random.choice(["en", "de", None]), random.choice(["src0", "src1", "src4", None]), len(text)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    for k, r in enumerate(clean[:30]):
        rows += [(1000 + k, *r[1:]), (1000 + k, *r[1:]), (None, *r[1:])]
    for k, r in enumerate(r for r in clean[60:110] if len(r[1].split()) > 60):
        changed = r[1].split()
        changed[len(changed) // 2] = "otherword"
        rows.append((2000 + k, " ".join(changed), "en", "src1", 1))
    rows += [(i, "seven copies of one text are here", "en", "src0", 1) for i in (3001, 3001, 3002, 3003, 3003, None, None)]
    rows += [(4000, None, "en", "src0", None), (4001, "", "en", "src0", 0)]
    return rows, labels


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows, model):
    weights = toxicity.WordWeights(model)
    kept = [r for r in rows if toxicity.score_text(r[1] or "", weights, None)[0] < 0.3]
    stages = [kept]
    best = {}
    for r in kept:
        key = r[1] or ""
        if key not in best or (best[key][0] is None or (r[0] is not None and r[0] > best[key][0])):
            best[key] = r
    stages.append(list(best.values()))
    rows, sets = stages[-1], [shingles(r[1]) for r in stages[-1]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    stages.append([min((r for r, h in zip(rows, group, strict=True) if h == g), key=lambda r: r[0]) for g in dict.fromkeys(group)])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(stages[-1], columns=["doc_id", "text", "lang", "source", "n_chars"]))
    chosen = {r[0] for r in con.execute(mixing(TREE_WEIGHTS, 1, 20, 0.8)).fetchall()}
    stages.append([r for r in stages[-1] if r[0] in chosen])
    return stages


def test_pipeline_equals_a_brute_force_one(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    settings = toxicity.Settings()
    model = toxicity.train(labelled_sample(
        docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic", fold("doc_id", 4) != 2, settings.per_class, settings.max_chars), settings)
    want = by_hand(rows, model)
    assert len(want[0]) < len(rows) and len(want[0]) > len(want[1]) > len(want[2]) > len(want[3]) > 100
    for (_, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in kept)
    library = Tokenizer.from_file(public_tokenizers.path(WORD_VOCABULARY))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want[3]}
    assert {r.doc_id: r.length for r in packed} == tokens and all(r.offset + r.length <= 4096 for r in packed)
    assert len({r.sequence_id for r in packed}) == -(-sum(tokens.values()) // 4096)


def test_seven_copies_leave_one_row(spark, tmp_path):
    rows = [(i, "one text", "en", "src0", 8) for i in (1, 1, 2, 3, 3, None, None)] + [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row_number", F.lit("clash"))
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.text, str(r.doc_id)) for r in got.collect()) == [("a", "None"), ("b", "None"), ("one text", "3")]
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.text, str(r.doc_id)) for r in near.collect()) == [("a", "None"), ("b", "None"), ("one text", "1")]


def test_written_stages_are_released(spark, small):
    from syllabix import session
    before = len(session._PINNED)
    corpus_pipeline.run(spark, small).count()
    assert len(session._PINNED) > before + 3
    release_pinned(spark, before)
    assert len(session._PINNED) == before
