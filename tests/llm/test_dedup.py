import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.odd import ODD
from helixspark.llm import bwt, exact_dedup, jaccard, repeats, storage

random.seed(4)
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Zeta", "êta", "thêta", "iota", "kappa"]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (i, t), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i, i))
    out = []
    for (i, t), n in zip(rows, norm, strict=True):
        keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[3]
        longest = -min(x[0] for x in groups[n])
        out.append((i, keep, len(groups[n]), i == keep and len(t or "") == longest, hashlib.sha256(n.encode()).hexdigest()))
    return out


key = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("rows", [ODD, [], [(i, ["same text", "same  text", "other"][i % 3]) for i in range(60)]])
def test_exact_dedup(docs_of, rows):
    df = docs_of(rows, extra=("size", "body", "kept", "digest"))
    found = exact_dedup.exact_dedup(df, salts=3).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=key) == sorted(exact_brute(rows), key=key)
    assert exact_dedup.keep_one(df, salts=3).columns == df.columns


def test_a_kept_row_is_known_by_its_text_too(docs_of):
    least = -(1 << 63)
    rows = [(4, "a b c"), (5, "a bc"), (5, "other"), (7, "x y"), (7, "x  y"), (least, "z"), (least + 1, "z"), (0, "z")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.keep_one(docs_of(rows)).collect()) == [(least, "z"), (4, "a b c"), (5, "other"), (7, "x  y")]


def sets_brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * union:
                links[a], links[b] = links[a] + 1, links[b] + 1
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    out = []
    for (i, _), s, x, n in zip(rows, sets, label, links, strict=True):
        ids = [j for (j, _), y in zip(rows, label, strict=True) if y == x and j is not None] if s else [i]
        out.append((i, len(s), min(ids, default=None), n))
    return out


def near_copies(rng, families, size, words):
    rows = []
    for _ in range(families):
        base = prose(rng.randint(2, words), rng).split()
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rows", [ODD, [], near_copies(random.Random(1), 12, 8, 200), near_copies(random.Random(2), 25, 5, 12), near_copies(random.Random(3), 1, 60, 150)])
def test_jaccard_components(docs_of, rows):
    found = jaccard.jaccard_components(docs_of(rows, extra=("n_shingles", "label", "node"))).collect()
    assert sorted(map(tuple, found), key=key) == sorted(sets_brute(rows, 4, 85), key=key)


def test_sets_that_only_rows_without_an_id_hold_link(docs_of):
    base = prose(200, random.Random(4))
    rows = [(None, base), (3, base + " more"), (None, base + " more of it"), (9, "other words than those")]
    found = jaccard.jaccard_components(docs_of(rows)).collect()
    assert sorted(map(tuple, found), key=key) == sorted(sets_brute(rows, 4, 85), key=key)


@pytest.mark.parametrize("most", [64, 1 << 26])
def test_likely_rows(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    rows = spark.range(5000).select(F.col("id").alias("place"), F.col("id").cast("string").alias("text"))
    found = jaccard.likely(rows, rows.where("place % 50 = 0"), "place")
    assert found.columns == ["place", "text"]
    places = {r.place for r in found.collect()}
    assert places >= set(range(0, 5000, 50))
    assert len(places) <= (1000 if most > 64 else 5000)
    assert jaccard.likely(rows, rows.where("place < 0"), "place").count() == 0


@pytest.mark.parametrize("block_items", [1, 150, 1 << 20])
def test_link_counts(spark, block_items):
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(60), rng.randint(40, 60))) for _ in range(30)] + [[1], [1, 2]]
    label = [i % 2 for i in range(30)] + [7, 8]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, items array<long>")
    nodes = spark.createDataFrame([(i, x, i % 3 + 1) for i, x in enumerate(label)], "node long, label long, copies long")
    found = {r.node: r.links for r in jaccard.link_counts(items, nodes, 70, block_items).collect()}
    like = lambda a, b: 100 * len({*a} & {*b}) >= 70 * len({*a} | {*b})
    assert found == {i: sum(j % 3 + 1 for j in range(32) if j != i and label[j] == label[i] and like(sets[i], sets[j])) for i in range(32)}


def test_keys_of_sets_are_wide():
    """The two halves of a key are different hashes, so that either tells sets apart."""
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in rng.integers(1, 30, 500)]
    keys = {jaccard.set_key(x) for x in sets}
    assert len(keys) == len({x.tobytes() for x in sets}) and {len(k) for k in keys} == {16}
    assert len({k[:8] for k in keys}) == len({k[8:] for k in keys}) == len(keys) and not {k[:8] for k in keys} & {k[8:] for k in keys}
    assert jaccard.set_key(sets[0][::-1]) == jaccard.set_key(sets[0])


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda: spark.createDataFrame([("x" * 100_000,)] * 200, "text string").coalesce(1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    had = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        storage.bound_batches(spark)
        assert len(found := sizes()) > 1 and all(r.n <= 2 * storage.BATCH_BYTES for r in found)
        spark.conf.set(key, "1000000")
        storage.bound_batches(spark)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, had)


def test_schemes_leave_no_pair_out():
    """Any pair that may link shares a signature: differences are put where they hurt most, one a segment."""
    import numpy as np

    plan, rng = jaccard.Plan(85), np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        most = n * 100 // 85 - n
        a, b = int(rng.integers(0, most + 1)), 0
        b = int(rng.integers(0, max(1, most - a + 1)))
        x = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, a).astype(np.uint64)]))
        y = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, b).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
            assert np.intersect1d(jaccard.signatures(x, plan), jaccard.signatures(y, plan)).size


def windows_brute(blobs, window):
    count = {}
    for b in blobs:
        for i in range(len(b) - window + 1):
            count[b[i : i + window]] = count.get(b[i : i + window], 0) + 1
    return [[count[b[i : i + window]] > 1 for i in range(len(b) - window + 1)] for b in blobs]


@pytest.mark.parametrize("window", [50, 47])
def test_the_merge_decides_which_windows_repeat(monkeypatch, window):
    import numpy as np

    rng = random.Random(window)
    passage = bytes(rng.choice(b"abcd") for _ in range(120))
    blobs = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(20, 60))) + passage[rng.randint(0, 60) : rng.randint(60, 120)] * (i % 3 > 0) + b"xy" * rng.randint(20, 40) for i in range(40)]
    for shard_of in (np.arange(40) // 7, np.zeros(40, np.int64)):
        found = repeats.repeated_starts([np.frombuffer(b, np.uint8) for b in blobs], window, 8, shard_of)
        assert [x.tolist() for x in found] == windows_brute(blobs, window)
    merged = bwt.merged
    for stub in (0, 1):  # nothing, or everything, has a common prefix
        monkeypatch.setattr(bwt, "merged", lambda transforms, depth, stub=stub: (merged(transforms, depth)[0], np.full(sum(map(len, transforms)), stub * depth)))
        assert [x.tolist() for x in repeats.repeated_starts([np.frombuffer(b, np.uint8) for b in blobs], window, 8, shard_of)] != windows_brute(blobs, window)


def test_blocks_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    data = np.frombuffer(b"abcdefgh1bcdefgh2bcdefghabcdefgh", np.uint8)
    rolling = repeats.Rolling(data)
    at, plain = np.arange(0, 32, 8), repeats.block_names(data, rolling, np.arange(0, 32, 8), 8)
    monkeypatch.setattr(repeats.Rolling, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    same = lambda names: [[a == b for b in names.tolist()] for a in names.tolist()]
    assert same(repeats.block_names(data, rolling, at, 8)) == same(plain) and plain[0] == plain[3] != plain[1]


def repeats_brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in data:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept))
    return out


def shared_passages(rng):
    rows, passage = [], prose(40, rng)
    for i in range(30):
        body = prose(rng.randint(1, 60), rng)
        rows.append(body + (" " + passage[rng.randint(0, 40) : -rng.randint(1, 40)] + " " + prose(5, rng)) * (i % 3))
    return [*enumerate(rows), (90, "ab" * 200), (91, "abc" * 31 + "x"), (92, "q" * 57), (93, "zé" * 90), (94, rows[0]), (94, rows[0])]


@pytest.mark.parametrize("rows", [ODD, [], shared_passages(random.Random(5)), shared_passages(random.Random(6))])
@pytest.mark.parametrize("bucket", [0, 1000])
def test_repeats(docs_of, rows, bucket):
    found = repeats.remove_repeats(docs_of(rows, extra=("row", "first", "starts")), window=50, gram=8, bucket_segments=bucket).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found]
    assert sorted(got, key=key) == sorted(repeats_brute(rows, 50), key=key)
