import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixspark.config import KmerConfig
from helixspark.functions import arrays, hashing, sequence
from helixspark.functions.sequence import CODES
from helixspark.operators.extract import canonical_windows


def codes(text):
    return CODES[np.frombuffer(text.encode(), np.uint8)]


@pytest.mark.parametrize(("text", "expected"), [("A" * 17, 0x864BA144DF098483), ("ACGTACGTACGTACGTA", 0x2614C45A50619313), ("GATTACAGATTACAGAT", 0x207D3BD8813BE123), ("C" * 31, 0x929788FFD166E4D0)])
def test_murmur_goldens(text, expected):
    assert int(hashing.murmur64(hashing.left_aligned(codes(text)[None]))[0]) == expected


def test_wang_golden_and_inverse():
    assert int(hashing.wang64(np.array([12345], np.uint64))[0]) == 0x6A484838548F8A63
    values = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (hashing.wang64_inverse(hashing.wang64(values)) == values).all()


def test_long_keys_hash_all_words():
    a, b = codes("A" * 95), codes("A" * 94 + "C")
    assert hashing.murmur64(hashing.left_aligned(a[None]))[0] != hashing.murmur64(hashing.left_aligned(b[None]))[0]


def superfast(data):
    """The hash a byte at a time, in Python's integers."""
    h, cut = len(data), lambda x: x & 0xFFFFFFFF
    for i in range(0, len(data) - 3, 4):
        h = cut(h + int.from_bytes(data[i : i + 2], "little"))
        h = cut(h << 16) ^ int.from_bytes(data[i + 2 : i + 4], "little") << 11 ^ h
        h = cut(h + (cut(h) >> 11))
    rest = data[len(data) // 4 * 4 :]
    alone = lambda b: cut(b - 256 if b > 127 else b)
    if rest:
        h = cut(h + (alone(rest[0]) if len(rest) == 1 else int.from_bytes(rest[:2], "little")))
        h ^= cut(h << {1: 10, 2: 11, 3: 16}[len(rest)])
        if len(rest) == 3:
            h ^= cut(alone(rest[2]) << 18)
        h = cut(h + (h >> {1: 1, 2: 17, 3: 11}[len(rest)]))
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h ^= cut(h << left)
        h = cut(h + (h >> right))
    return h if data else 0


@given(st.lists(st.binary(max_size=23), max_size=8))
def test_superfast_of_columns(rows):
    assert hashing.superfast32(pa.array([*rows, None], pa.binary())).tolist() == [*map(superfast, rows), 0]


@given(st.lists(st.one_of(st.none(), st.text("ACGT", max_size=30)), max_size=6))
def test_joined_and_back(rows):
    column = pa.array(["GG", *rows], pa.string())[1:]
    data, offsets = arrays.joined(column)
    assert arrays.rows_of(data, offsets, pa.string(), ~np.asarray(column.is_null())).to_pylist() == rows


@given(st.text("ACGT", min_size=3, max_size=120), st.integers(3, 95))
def test_windows_equal_text(seq, k):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    expected = [min(seq[i : i + k], rc(seq[i : i + k])) for i in range(len(seq) - k + 1)]
    found = ["".join("".join("ACGT"[int(w) >> 2 * (size - 1 - j) & 3] for j in range(size)) for w, size in zip(row, [min(31, k - a) for a in range(0, k, 31)], strict=True)) for row in canonical_windows(codes(seq), k)]
    assert found == expected


def test_scalars(spark):
    df = spark.createDataFrame([("acgtNNac",)], "s string")
    row = df.select(
        sequence.normalise(F.col("s")).alias("n"),
        sequence.decode_2bit(sequence.encode_2bit("s"), F.length("s")).alias("d"),
        sequence.reverse_complement(F.lit("AACG")).alias("rc"),
        sequence.canonical(F.lit("TTTT")).alias("c"),
        sequence.roll(F.lit("ACG"), F.lit("T")).alias("r"),
        sequence.bytes_needed(F.lit(5)).alias("b"),
        sequence.padding_bases(F.lit(5)).alias("p"),
        sequence.supermer_bytes(F.lit(8)).alias("sb"),
        sequence.base_code(F.lit("n")).alias("bn"),
        sequence.base_code(F.lit("R")).alias("br"),
        sequence.code_base(F.lit(4)).alias("cx"),
        sequence.unpack(sequence.pack(F.lit("ACGTA")), 5).alias("pk"),
    ).first()
    assert tuple(row) == ("ACGTAAAC", "ACGTAAAC", "CGTT", "AAAA", "CGT", 2, 3, 3, 0, 4, "X", "ACGTA")


def test_invalid_characters(spark):
    df = spark.createDataFrame([("ACRU",), (None,)], "s string")
    assert [r[0] for r in df.select(sequence.normalise(F.col("s"), "drop")).collect()] == ["AC", None]
    assert df.select(sequence.normalise(F.col("s"), "as_a")).first()[0] == "ACAA"
    with pytest.raises(Exception, match="not a DNA sequence"):
        df.select(sequence.normalise(F.col("s"))).collect()


@pytest.mark.parametrize("bad", [{"k": 2}, {"k": 96}, {"m": 31}, {"min_count": 0}, {"min_count": 9, "max_count": 8}, {"max_count": 65536}, {"max_supermer_len": 30}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        KmerConfig(**bad)
