import random
import re

import corpus_pipeline
from tests.llm.test_dedup import sets_brute
from tests.llm.test_text_ops import _ENC

CLEAN = ["river", "stone", "bread", "window", "garden", "music", "paper", "light", "cloud", "street"]


def corpus(rng):
    word = lambda: rng.choice(CLEAN) + str(rng.randint(0, 60))
    items = [(i, " ".join(word() + "q" for _ in range(30))) for i in range(5)]
    rows, toxic, leaked = [], set(), set()
    for i in range(400):
        body = [word() for _ in range(rng.randint(8, 120))]
        if i % 9 == 0:
            body.insert(3, "scum")
            toxic.add(i)
        if i % 11 == 0:
            body[4:4] = items[i % 5][1].split()
            leaked.add(i)
        rows.append((i, " ".join(body)))
    for i in range(400, 480):  # copies and near copies
        words = rows[rng.randrange(0, 400)][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = word()
        rows.append((i, ("  " if i % 4 else " ").join(words)))
    rows += [(480, None), (481, ""), (482, " ")]
    has = lambda t, s: s in (t or "")
    return rows, items, {i for i, t in rows if has(t, "scum")}, {i for i, t in rows if any(sum(w in (t or "").split() for w in s.split()) >= 24 for _, s in items)}


def test_run_equals_brute_force(spark, docs_of, tmp_path):
    rows, items, toxic, leaked = corpus(random.Random(2))
    docs = docs_of(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(i, t) for i, t in rows if i not in toxic]
    best = {}
    for i, t in left:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[norm] = min(best.get(norm, (1, 0)), (-len(t or ""), i))
    left = [(i, t) for i, t in left if i in {b[1] for b in best.values()}]
    kept = {c for _, _, c, _ in sets_brute(left, 4, 85)}
    left = [(i, t) for i, t in left if i in kept and i not in leaked]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in found) == sorted((i, len(_ENC.encode_ordinary(t or "")), t or "") for i, t in left)


def test_stages_keep_columns_and_bear_empty_tables(spark, docs_of, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(0, None), (1, "a b c d"), (None, "x"), (None, "")]):
        docs = docs_of(rows, extra=("score", "kept"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
        assert len(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == len(rows)
