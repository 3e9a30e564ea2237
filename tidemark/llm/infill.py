"""Fill-in-the-middle: texts cut at token borders by a succinct rank and select index.

Tokens end where white space follows other text, and at the text's end. A batch's texts lie behind each
other in one buffer; one bit a byte says where a token ends. The bits are packed, and a directory holds the
number of set bits before each block of 512, so that rank takes one look into the directory and one popcount of
a block, and select a binary search and the same. A text's rank at its end less that at its start is its number
of tokens n; select on two ranks gives the bytes at which it is cut. A second such index over the bytes that begin
a code point turns bytes into code points. Texts go to Python once, as Arrow buffers, and only numbers return.

Defined results: a null text is an empty one, which stays plain with n = 0; a null id hashes as the text ``null``;
texts of any length are cut whole, in bounded slices; rows that repeat an id are cut by the same draws, each by its
own n; texts that hold a mark stay plain; an empty table gives an empty result; other columns don't matter.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the three parts. Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of packed bits in a block of the directory, and bytes of text that are looked at together.
BLOCK, SLICE = 64, 1 << 22

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class RankSelect:
    """Packed bits, and the number of set bits before each block."""

    def __init__(self, packed: np.ndarray):
        self.blocks = np.zeros((len(packed) // BLOCK + 1, BLOCK), np.uint8)
        self.blocks.reshape(-1)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.blocks).sum(1, dtype=np.int64), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block, bit = at // (8 * BLOCK), at % (8 * BLOCK)
        whole = np.arange(BLOCK) < (bit >> 3)[:, None]
        part = np.bitwise_count(self.blocks[block, bit >> 3] >> (8 - (bit & 7)).astype(np.uint8)) if len(at) else np.zeros(0, np.int64)
        return self.before[block] + np.where(whole, np.bitwise_count(self.blocks[block]), 0).sum(1, dtype=np.int64) + part

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the set bit that has ``k`` set bits before it; no meaning where there is none."""
        block = np.minimum(np.searchsorted(self.before, k, side="right"), len(self.blocks)) - 1
        upto = np.bitwise_count(self.blocks[block]).cumsum(1, dtype=np.int64)
        left = k - self.before[block]
        byte = np.minimum((upto <= left[:, None]).sum(1), BLOCK - 1)
        rows = np.arange(len(k))
        left = left - np.where(byte > 0, upto[rows, np.maximum(byte, 1) - 1], 0)
        bits = np.unpackbits(self.blocks[block, byte][:, None], axis=1)
        return block * 8 * BLOCK + byte * 8 + ((bits.cumsum(1) == (left + 1)[:, None]) & (bits == 1)).argmax(1)


def indexes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[RankSelect, RankSelect]:
    """Of the bytes of a batch: where tokens end, and where code points begin."""
    last = np.unique(ends[ends > starts] - 1)
    tokens, points = np.zeros(-(-len(data) // 8), np.uint8), np.zeros(-(-len(data) // 8), np.uint8)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        blank = _BLANK[data[at : at + SLICE + 1]]
        ends_here = ~blank[: len(part)]
        ends_here[: len(blank) - 1] &= blank[1:]
        ends_here[last[(last >= at) & (last < at + len(part))] - at] = True
        where = slice(at // 8, -(-(at + len(part)) // 8))
        tokens[where], points[where] = np.packbits(ends_here), np.packbits((part & 0xC0) != 0x80)
    return RankSelect(tokens), RankSelect(points)


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """Number of tokens, the two cuts in bytes, and code points of the first two parts, of each text and its two draws."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    tokens, points = indexes(data, starts, ends)
    base = tokens.rank(starts)
    n = tokens.rank(ends) - base
    a, b = first % (n + 1), second % (n + 1)
    low, high = (np.where(k > 0, tokens.select(base + np.maximum(k, 1) - 1) + 1, starts) if len(data) else starts for k in (np.minimum(a, b), np.maximum(a, b)))
    low, high = (np.where(n > 0, x, starts) for x in (low, high))
    of = [points.rank(x) for x in (starts, low, high)]
    return {"n": n, "first_cut": low - starts, "second_cut": high - starts, "prefix_chars": of[1] - of[0], "middle_chars": of[2] - of[1]}


def cuts_column(text: Column, first: Column, second: Column) -> Column:
    """``cuts`` as a struct column of longs; the two draws are longs of 0 or more."""

    @F.arrow_udf("n long, first_cut long, second_cut long, prefix_chars long, middle_chars long")
    def run(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        found = cuts(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))

    return run(F.coalesce(text, F.lit("")).cast("binary"), first, second)


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four numbers from 0 to 2**32 - 1 that follow from the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text plain, or its prefix, suffix and middle behind their marks.

    ``rate`` percent of the texts are cut; ``suffix_first`` percent of these put the suffix first (``spm``), the others
    the prefix (``psm``).
    """
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = df.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text"), h3.alias("_h3"), h4.alias("_h4"), cuts_column(F.col(text_col), h1, h2).alias("_cut"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("_text"), F.lit(mark))
    plain = (F.col("_cut.n") == 0) | (F.col("_h3") % 100 >= rate) | marked
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("_h4") % 100 < suffix_first, "spm").otherwise("psm"))
    raw, low, high = F.col("_text").cast("binary"), F.col("_cut.first_cut").cast("int"), F.col("_cut.second_cut").cast("int")
    prefix, middle, suffix = F.substring(raw, F.lit(1), low), F.substring(raw, low + 1, high - low), F.substring(raw, high + 1, F.octet_length(raw))
    p, s, m = (F.lit(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "plain", raw).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    chars = {c: F.when(F.col("form") != "plain", F.col(f"_cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")}
    return rows.select(id_col, F.col("_cut.n").alias("n"), "form", *chars.values(), output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; each mark occurs once in one that isn't plain."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    after = part(output, MIDDLE, 2)
    head = part(output, MIDDLE, 1)
    psm = F.concat(part(part(head, PREFIX, 2), SUFFIX, 1), after, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), after, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
