"""Scalar functions on DNA text. A sequence is a STRING over A, C, G, T; N counts as A and case does not matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixspark.functions.arrays import joined, pieces, rows_of

#: Bytes of text to 2-bit codes; 4 marks what is not a base.
CODES = np.full(256, 4, np.uint8)
for _code, _letters in enumerate(("AaNn", "Cc", "Gg", "Tt")):
    for _letter in _letters:
        CODES[ord(_letter)] = _code
#: The reverse, for 0 to 3.
BASES = np.frombuffer(b"ACGT", np.uint8)


def checked_codes(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """2-bit codes of the bytes of sequences; anything but a base fails, and the message shows its sequence."""
    codes = CODES[text]
    if (codes > 3).any():
        row = int(np.searchsorted(offsets, int(np.argmax(codes > 3)), "right")) - 1
        raise ValueError(f"not a DNA sequence: {text[offsets[row] : offsets[row + 1]][:80].tobytes().decode(errors='replace')}")
    return codes


def normalise(seq: Column, invalid: str = "error") -> Column:
    """Upper case with N as A. Other characters fail ('error'), become A ('as_a') or are taken out ('drop')."""
    if invalid not in ("error", "as_a", "drop"):
        raise ValueError(f"invalid must be error, as_a or drop, not {invalid}")
    upper = F.upper(seq)
    if invalid == "as_a":
        return F.regexp_replace(upper, "[^CGT]", "A")
    if invalid == "drop":
        return F.translate(F.regexp_replace(upper, "[^ACGTN]+", ""), "N", "A")
    plain = F.translate(upper, "N", "A")
    return F.when(plain.rlike("^[ACGT]*$"), plain).when(plain.isNotNull(), F.raise_error(F.concat(F.lit("not a DNA sequence: "), F.substring(seq, 1, 80))))


def base_code(base: Column) -> Column:
    """0 to 3 for A (and N), C, G, T; 4 for anything else."""
    at = F.instr(F.lit("ACGT"), F.translate(F.upper(base), "N", "A"))
    return F.when((at > 0) & (F.length(base) == 1), at - 1).when(base.isNotNull(), F.lit(4))


def code_base(code: Column) -> Column:
    """A, C, G, T for 0 to 3; X for 4."""
    return F.substr(F.lit("ACGTX"), code + 1, F.lit(1))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    return F.least(seq, reverse_complement(seq))


def base_at(seq: Column, i: Column) -> Column:
    """Code of the base at 0-based position i."""
    return base_code(F.substr(seq, i + 1, F.lit(1)))


def revcomp_at(seq: Column, i: Column) -> Column:
    """Code of the reverse complement's base at position i."""
    return 3 - base_code(F.substr(seq, F.length(seq) - i, F.lit(1)))


def roll(kmer: Column, base: Column) -> Column:
    """Drop the first base and append one."""
    return F.concat(F.substr(kmer, F.lit(2), F.length(kmer)), base)


def bytes_needed(length: Column) -> Column:
    """Bytes of a 2-bit encoding."""
    return F.floor((length + 3) / 4)


def padding_bases(length: Column) -> Column:
    """Unused base positions in the last byte of a 2-bit encoding."""
    return 4 * bytes_needed(length) - length


def supermer_bytes(length: Column) -> Column:
    """Bytes of a supermer on the wire: one is spare where the length is a multiple of four."""
    return F.floor(length / 4) + 1


def kmer_count_of(length: Column, k: int) -> Column:
    return F.greatest(length - (k - 1), F.lit(0))


@F.arrow_udf(T.BinaryType())
def encode_2bit(seq: pa.Array) -> pa.Array:
    """Four bases a byte, the first in the high bits; the last byte is filled with zeros. Null stays null."""
    text, offsets = joined(seq)
    codes = checked_codes(text, offsets)
    length = np.diff(offsets)
    size = (length + 3) // 4
    out = np.concatenate([[0], np.cumsum(size)])
    quads = np.zeros(4 * int(out[-1]), np.uint8)
    quads[np.repeat(4 * out[:-1] - offsets[:-1], length) + np.arange(len(codes))] = codes
    return rows_of(quads.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8), out, pa.binary(), ~np.asarray(seq.is_null()))


@F.arrow_udf(T.StringType())
def decode_2bit(data: pa.Array, length: pa.Array) -> pa.Array:
    """The ``length`` bases of a 2-bit encoding. Null stays null."""
    packed, offsets = joined(data)
    letters = BASES[(packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].ravel()
    valid = ~np.asarray(data.is_null()) & ~np.asarray(length.is_null())
    size = np.where(valid, np.asarray(length.fill_null(0), np.int64), 0)
    return rows_of(*pieces(letters, 4 * offsets[:-1], size), pa.string(), valid)


def pack(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a non-negative LONG; order is that of the text."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack(packed: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(packed.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
