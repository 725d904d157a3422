"""The corpus pipeline on a small fixture, stage by stage, against plain Python."""

import tempfile

import numpy as np

import corpus_pipeline
from tarmac.llm import pieces, simhash
from tarmac.llm.catalog import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark):
    rng = np.random.default_rng(11)
    words = {"en": [f"the{i}ing" for i in range(300)], "de": [f"ung{i}über" for i in range(300)]}
    rows = []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(words[lang], 120)), lang, f"s{i % 4}"))
    near = rows[10][1].split()
    near[60] = "changed"
    rows += [(400, rows[0][1].upper(), "en", "s1"), (401, rows[1][1], None, "s2"), (402, " ".join(near), "en", "s0"),
             (403, "12 34 --", None, "s0"), (404, None, None, None)]
    path = tempfile.mkdtemp(prefix="tarmac-pipeline-")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return path, {r[0]: r for r in rows}


def test_pipeline_against_brute_force(spark):
    path, rows = fixture(spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language ID"](spark, docs, path)
    assert identified.columns == COLUMNS
    ids = {r.doc_id for r in identified.collect()}
    assert ids == set(rows) - {403, 404}
    unique = stages["exact dedup"](spark, identified, path)
    best = {}
    for i in ids:
        t = rows[i][1].lower()
        best[t] = max(i, best.get(t, i))
    kept = {r.doc_id for r in unique.collect()}
    assert unique.columns == COLUMNS and kept == set(best.values()) and {400, 401} <= kept
    single = stages["SimHash near-dedup"](spark, unique, path)
    prints = {i: simhash.fingerprint(rows[i][1]) for i in kept}
    groups = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if groups[a] < groups[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    groups[b], changed = groups[a], True
    left = {r.doc_id for r in single.collect()}
    assert single.columns == COLUMNS and left == set(groups.values())
    mixed = stages["source mixing"](spark, single, path)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == COLUMNS and set(counts) <= left and max(counts.values()) <= 2
    words = sum(counts[i] * len(rows[i][1].split()) for i in counts)
    assert abs(words - 1.5 * sum(len(rows[i][1].split()) for i in left)) <= 4 * 120
    encoded = stages["SentencePiece"](spark, mixed, path)
    back = pieces.decode_documents(encoded).collect()
    assert len(back) == sum(counts.values()) and all(r.text == rows[r.doc_id][1] for r in back)
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(str, whole)) == sorted(map(str, encoded.collect()))


def test_catalog_covers_the_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
