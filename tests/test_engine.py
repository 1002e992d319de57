import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixspark import cli
from helixspark.operators import count, extract, minimizer
from helixspark.plans import catalog
from helixspark.sources import fasta
from helixspark.streaming.counts import append_counts, appended_totals, banded, streaming_counts

RAW = ["ACGTACGTAC", "acgtnACGTT", "GTTTT", "ACG"]
K5 = {"AAAAC": [(2, 0)], "AACGT": [(1, 4), (1, 5)], "ACGTA": [(0, 0), (0, 3), (0, 4), (1, 0)], "CGTAA": [(1, 1)], "CGTAC": [(0, 1), (0, 2), (0, 5)], "CGTTA": [(1, 3)], "GTAAC": [(1, 2)]}


@pytest.fixture(scope="module")
def reads(spark):
    return fasta.reads_from(spark.createDataFrame(list(enumerate(RAW)), "id long, s string"), "id", "s").cache()


@pytest.mark.parametrize("method", ["packed", "text"])
def test_counts_and_positions(reads, method):
    assert {r.kmer: r.cnt for r in count.count_kmers(reads, 5, 1, 65535, method=method).collect()} == {k: len(v) for k, v in K5.items()}
    assert {r.kmer for r in count.count_kmers(reads, 5, 2, 3, method=method).collect()} == {"AACGT", "CGTAC"}
    found = count.count_kmers(reads, 5, 1, 65535, with_positions=True, method=method).collect()
    assert {r.kmer: [tuple(x) for x in r.occ] for r in found} == K5


@pytest.mark.parametrize("k", [3, 4, 31, 32, 33, 62, 63, 64, 93, 94, 95])
def test_methods_agree(spark, k):
    seqs = ["ACGTTGCA" * 16 + "GATTACA", "TGCAACGT" * 13, "A" * k, "A" * (k - 1)]
    df = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string")
    both = [{tuple(r) for r in count.count_kmers(df, k, 1, 65535, method=m).collect()} for m in ("packed", "text")]
    assert both[0] == both[1] and sum(c for _, c in both[0]) == sum(max(0, len(s) - k + 1) for s in seqs)
    flipped = df.withColumn("seq", F.when(F.col("rid") == 0, F.reverse(F.translate("seq", "ACGT", "TGCA"))).otherwise(F.col("seq")))
    assert {tuple(r) for r in count.count_kmers(flipped, k, 1, 65535).collect()} == both[0]


def test_long_reads_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(extract, "_SLICE", 10)
    seqs = ["ACGTTGCAGATTACAGGCCA", "ACG", None, "", "GATTACAGATTACAGA"]
    expected = [(i, p, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))) for i, s in enumerate(seqs) for p in range(len(s or "") - 4) for w in [s[p : p + 5]]]
    rows = [(i, p, "".join("ACGT"[int(w) >> 2 * j & 3] for j in range(4, -1, -1))) for codes, start, row, pos in extract.slices(pa.array(seqs), 5) for i, p, (w,) in zip(row.tolist(), pos.tolist(), extract.canonical_windows(codes, 5)[start], strict=True)]
    assert rows == expected


@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_slices_do_not_cut_supermers(spark, monkeypatch, step):
    draw = random.Random(3)
    seqs = ["".join(draw.choice("ACGT") for _ in range(draw.randint(0, 300))) for _ in range(40)] + ["A" * 500]
    whole = minimizer._starts
    monkeypatch.setattr(extract, "_SLICE", step)
    monkeypatch.setattr(minimizer, "_PART_BASES", 1000)
    row, task = [], []
    for i, s in enumerate(seqs):
        found = minimizer.read_minimizers(s, 9, 4) % np.uint64(5)
        row += [i] * len(found)
        task += found.astype(int).tolist()
    starts = whole(np.array(row), np.array(task), 20 - 9 + 1)
    # the same function as tasks run it, over slices of a batch
    df = spark.createDataFrame(list(enumerate(seqs)), "rid long, seq string").coalesce(1)
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.extend(run(iter(pa.RecordBatch.from_pandas(self.toPandas()) for _ in range(1)))) or df)
    minimizer.supermers(df, 9, 4, 5, 20)
    got = [(r["rid"], r["pos"], r["len"], r["task"], r["seq"]) for b in held for r in b.to_pylist()]
    first = {i: row.index(i) for i in set(row)}
    ends = [*starts[1:], len(row)]
    assert got == [(row[a], int(a - first[row[a]]), int(b - a + 8), task[a], seqs[row[a]][a - first[row[a]] : b - first[row[a]] + 8]) for a, b in zip(starts.tolist(), ends, strict=True)]


def test_frequent_kmers_are_not_sent(spark):
    df = spark.createDataFrame([(0, "A" * 400 + "C" + "ACGTTGCA" * 3), (1, "ACGTTGCA")], "rid long, seq string")
    sent = extract.packed_occurrences(df.coalesce(1), 5, 10)
    assert sent.count() == extract.packed_occurrences(df, 5).count() - 396
    both = [{tuple(map(str, r)) for r in count.count_kmers(df, 5, 2, 10, with_positions=True, method=m).collect()} for m in ("packed", "text")]
    assert both[0] == both[1] and both[0]


def test_histogram_totals_and_empty_input(spark, reads):
    assert fasta.format_histogram(count.kmer_histogram(count.count_kmers(reads, 5, 1, 65535))) == "#count\tnumkmers\n1\t4\n2\t1\n3\t1\n4\t1"
    assert tuple(count.totals(reads, 5).first()) == (4, 28, 10, 9, 1, 13)
    assert tuple(count.distinct_total(reads, 5).first()) == (7, 13)
    none = spark.createDataFrame([], "rid long, seq string")
    assert count.count_kmers(none, 31).count() == 0 and tuple(count.distinct_total(none, 31).first()) == (0, 0)
    assert [tuple(r) for r in count.top_kmers(count.all_counts(reads, 5), 2).collect()] == [("ACGTA", 4), ("CGTAC", 3)]
    assert count.merge_counts(count.partial_counts(reads, 5, 3)).count() == 7


def test_supermers(reads):
    rows = {(r.rid, r.pos, r.len, r.task, r.seq) for r in minimizer.supermers(reads, 5, 3, 3).collect()}
    assert rows == {(0, 0, 10, 1, "ACGTACGTAC"), (1, 0, 7, 1, "ACGTAAC"), (1, 3, 7, 2, "TAACGTT"), (2, 0, 5, 0, "GTTTT")}
    short = minimizer.supermers(reads, 5, 3, 3, max_len=6)
    assert max(r.len for r in short.collect()) == 6
    tiled = {(r.rid, r.pos, r.kmer) for r in minimizer.supermer_kmers(short, 5).collect()}
    assert tiled == {tuple(r) for r in extract.canonical_kmers(reads, 5).collect()}
    sizes = minimizer.task_sizes(minimizer.supermers(reads, 5, 3, 3), 5)
    assert {r.task: r.n_kmers for r in sizes.collect()} == {0: 1, 1: 9, 2: 3}
    assert [r.task for r in minimizer.heavy_tasks(sizes, 3, 1.5).where("heavy").collect()] == [1]


def test_minimizers_are_strand_symmetric():
    seq = "ACGTTGCAGATTACAGGCCATTTGACCA"
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert list(minimizer.read_minimizers(seq, 9, 4)) == list(minimizer.read_minimizers(back, 9, 4))[::-1]
    assert [hex(int(x)) for x in minimizer.read_minimizers("ACGTAACGTT", 5, 3)] == ["0x1a23ab22a9a17e7a"] * 3 + ["0x6337af9674d0ba30"] * 3


def test_balanced_dispatch(spark):
    tasks = spark.createDataFrame([(0, 10, 1), (1, 9, 1), (2, 3, 2), (3, 3, 1), (4, 2, 1), (5, 1, 1)], "task int, n_bytes long, coe long")
    # the largest two first; the others from small to large, from the last worker back, under 14 times the multiple
    assert {tuple(r) for r in minimizer.balanced(tasks, 2).collect()} == {(0, 0), (1, 1), (5, 1), (4, 0), (2, 1), (3, 0)}
    # the size that is looked at is the plain one, but a weight of two counts twice once it is placed
    assert {tuple(r) for r in minimizer.balanced(tasks, 2, weight_col="coe").collect()} == {(0, 0), (1, 1), (5, 1), (4, 0), (2, 1), (3, 0)}
    with pytest.raises(ValueError):
        minimizer.balanced(spark.createDataFrame([(i, 10) for i in range(5)], "task int, n_bytes long"), 4)
    assert minimizer.balanced(tasks.limit(0), 3).count() == 0
    assert minimizer.hash_owner(np.array([0, 1 << 63, (1 << 64) - 1], np.uint64), 7).tolist() == [0, 3, 6]


def test_fasta_round_trip(spark, tmp_path, capsys):
    text = ">r0 first\nACGTACG\nTAC\n>r1\nacgtnACGTT\n>r2\nGTTTT\n>r3\r\nACG\r\n"
    path = str(tmp_path / "in.fa")
    with open(path, "w", newline="") as f:
        f.write(text)
    with open(path + ".fai", "w") as f:
        f.write("r0\t10\t10\t7\t8\nr1\t10\t26\t10\t11\nr2\t5\t41\t5\t6\nr3\t3\t52\t3\t5\n")
    expected = [(0, "r0", "ACGTACGTAC"), (1, "r1", "ACGTAACGTT"), (2, "r2", "GTTTT"), (3, "r3", "ACG")]
    assert sorted(tuple(r) for r in fasta.read_fasta(spark, path).collect()) == expected
    assert sorted(tuple(r) for r in fasta.read_fasta_indexed(spark, path).collect()) == expected
    assert [tuple(r) for r in fasta.index_fasta(spark, path).collect()] == [("r0", 10, 10, 7, 8), ("r1", 10, 26, 10, 11), ("r2", 5, 41, 5, 6), ("r3", 3, 52, 3, 5)]
    assert [(r.rid, r.name, r.len) for r in fasta.read_fai(spark, path + ".fai").orderBy("rid").collect()][1] == (1, "r1", 10)
    out = str(tmp_path / "out")
    printed = cli.main([path, out, "-k", "5", "--min-count", "2", "--max-count", "3"], spark)
    assert printed == "#count\tnumkmers\n2\t1\n3\t1"
    assert {tuple(r) for r in fasta.read_counts(spark, out).collect()} == {("AACGT", 2), ("CGTAC", 3)}
    reads = fasta.read_fasta(spark, path)
    fasta.write_reads(reads, str(tmp_path / "seqs"))
    assert spark.read.text(str(tmp_path / "seqs")).count() == 4
    assert {tuple(r) for r in fasta.from_packed(fasta.to_packed(reads)).select("rid", "seq").collect()} == {(a, c) for a, _, c in expected}


def test_many_splits_keep_file_order(spark, tmp_path):
    path = str(tmp_path / "big.fa")
    with open(path, "w") as f:
        f.writelines(f">r{i}\n{'ACGT' * 20}\n{'GGCA' * (i % 7)}\n" for i in range(3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = fasta.read_fasta(spark, path)
        assert rows.where(F.concat(F.lit("r"), F.col("rid")) == F.col("name")).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_index_goes_by_bytes_not_by_names(spark, tmp_path):
    path = str(tmp_path / "in.fa")
    draw = random.Random(5)
    seqs = ["".join(draw.choice("ACGT") for _ in range(draw.randint(0, 900))) for _ in range(60)]
    with open(path, "w") as f:
        f.writelines(f">same {i}\n" + "".join(s[a : a + 50] + "\n" for a in range(0, len(s), 50)) for i, s in enumerate(seqs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        index = fasta.index_fasta(spark, path)
        assert [r.len for r in index.collect()] == [len(s) for s in seqs]
        with open(path, "rb") as f:
            data = f.read()
        assert all(data[r.pos - 1 : r.pos] == b"\n" and data[r.pos : r.pos + 20].split(b"\n")[0].decode() == s[:20] for r, s in zip(index.collect(), seqs, strict=True))
        fasta.write_fai(index.where("len % 2 = 0").coalesce(1), path + ".fai")
        found = fasta.read_fasta_indexed(spark, path)
        assert sorted(r.seq for r in found.collect()) == sorted(s for s in seqs if len(s) % 2 == 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_appended_reads_are_numbered_on(spark):
    a, b = (spark.createDataFrame([(i, s * (i + 1)) for i in range(n)], "rid long, seq string") for s, n in (("A", 5), ("C", 4)))
    assert sorted(tuple(r) for r in fasta.append_reads(a, b).collect()) == [*((i, "A" * (i + 1)) for i in range(5)), *((5 + i, "C" * (i + 1)) for i in range(4))]


def test_stream_equals_batch(spark, reads, tmp_path):
    source = str(tmp_path / "reads")
    reads.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming_counts(stream, 5).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {tuple(r) for r in count.count_kmers(reads, 5, 2, 65535).collect()}
    assert {tuple(r) for r in banded(spark.table("streamed"), 2, 65535).collect()} == expected
    out = str(tmp_path / "appended")
    for _ in range(2):  # a second run finds nothing new
        append_counts(stream, 5, out, str(tmp_path / "second"), availableNow=True).awaitTermination()
        assert {tuple(r) for r in appended_totals(spark, 5, out, 2).collect()} == expected


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


def test_contiguous_ranges(spark, monkeypatch):
    from helixspark.operators import ranges

    def greedy(sizes, parts):
        out, at = [], 0
        while at < len(sizes):
            end = at + 1
            while end < len(sizes) and (len(out) == parts - 1 or sum(sizes[at : end + 1]) < sum(sizes) / parts):
                end += 1
            out.append((len(out), 3 * at, 3 * (end - 1), sum(sizes[at:end])))
            at = end
        return out

    draw = random.Random(2)
    monkeypatch.setattr(ranges, "_READS", 3)
    for sizes, parts in [([5, 1, 1, 1, 8, 2, 2], 2), ([9], 3), ([1, 1], 5), ([], 2), ([draw.choice([1, 2, 30]) for _ in range(40)], 4)]:
        df = spark.createDataFrame([(3 * i, "A" * n) for i, n in enumerate(sizes)], "rid long, seq string")
        found = ranges.contiguous_ranges(df, parts, steps=6)
        assert sorted(tuple(r) for r in found.collect()) == greedy(sizes, parts)
        assert {tuple(r) for r in ranges.owners(df.select("rid"), found).collect()} == {(r, p) for p, a, b, _ in greedy(sizes, parts) for r in range(a, b + 1, 3)}


def test_diagnostics():
    from helixspark.diagnostics import memory, timed

    with timed("nothing") as took:
        pass
    assert took["seconds"] >= 0 and all(v > 0 for v in memory().values())


def _both(spark, name, texts, folder):
    """A query's rows and those of its SQL, over documents with these texts."""
    path = str(folder)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
        return [tuple(r) for r in catalog.queries()[name](spark, path).collect()], con.execute(catalog.oracle_sql()[name]).fetchall()


def test_top_kmers_keep_to_the_band(spark, tmp_path):
    found, expected = _both(spark, "top_kmers", ["A" * 65_600, "ACGTTGCAGATTACAGGCCATTTGACCA" * 3, "C" * 65_555], tmp_path)
    assert found == expected and found[0] == ("C" * 21, 65_535)  # the most that the band has; 65,580 is beyond


ODD = ["ACGTTGCANGATTACAGGCCATTTGACCA" * 9, None, "ACGTACGTACGTACGT", "ACGTACGTACGTACGTA", "xx", "T" * 400]


@pytest.mark.parametrize("name", ["murmur64", "superfast32"])
def test_hashes_make_no_row_of_a_window(spark, tmp_path, name):
    found, expected = _both(spark, name, ODD, tmp_path)
    assert sorted(found) == sorted(expected) and len(found) == 3
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "ArrowEvalPython" not in plan


def test_sums_over_windows_of_a_read_in_pieces(spark):
    seq = "".join(random.Random(5).choices("ACGT", k=(1 << 20) + 300))
    df = spark.createDataFrame([(1, seq), (2, "A" * 40), (2, "C" * 39), (3, "ACG")], "rid long, seq string")
    values = lambda codes, start: extract.packed_windows(codes, 20)[start, 0].view(np.int64)
    found = extract.window_sums(df, 20, values, {"mixed": (np.bitwise_xor, F.bit_xor), "least": (np.minimum, F.min)}).collect()
    whole = extract.packed_windows(extract.checked_codes(*extract.joined(pa.array([seq]))), 20)[:, 0].view(np.int64)
    assert sorted(map(tuple, found)) == [(1, len(whole), int(np.bitwise_xor.reduce(whole)), int(whole.min())), (2, 41, 0, 0)]


def test_top_kmers_have_no_upper_count(spark, tmp_path):
    found, expected = _both(spark, "top_kmers", ["A" * 65_600, "ACGTTGCAGATTACAGGCCATTTGACCA" * 3, "C" * 65_555, None, "no"], tmp_path)
    assert found == expected and found[:2] == [("A" * 21, 65_580), ("C" * 21, 65_535)]


@pytest.mark.parametrize("k", [5, 21, 33])
def test_most_frequent_are_those_of_all_counts(spark, k):
    rng = random.Random(k)
    often = ["".join(rng.choices("ACGT", k=60)) for _ in range(5)]
    rows = [(i, rng.choice(often)[rng.randrange(9) :] if i % 2 else "".join(rng.choices("ACGT", k=rng.randrange(90)))) for i in range(600)]
    rows.append((600, "".join(rng.choices("ACGT", k=70)) * 16_000))  # over a million windows, more than are handled at a time
    df = spark.createDataFrame(rows, "rid long, seq string").repartition(3)
    every = sorted(((r.kmer, r.cnt) for r in count.all_counts(df, k).collect()), key=lambda r: (-r[1], r[0]))
    for n in (1, 7, 100, len(every) + 1):
        assert [tuple(r) for r in count.most_frequent(df, k, n).collect()] == every[:n]
    assert count.most_frequent(df.where("rid < 0"), k, 3).count() == 0
