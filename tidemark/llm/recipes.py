"""Exact dedup by content-defined chunk recipes, of DataFrame functions only.

A text is compared without its white space. It is cut into chunks where its own bytes say so: a cut falls
where the last ``WINDOW`` bytes all lie in a fixed half of the byte values, after ``LEAST`` bytes and before
``MOST``. So texts that share passages share chunks, wherever these begin. Each distinct chunk travels
once, in one aggregate that proves that no two unlike chunks have one identifier; a text is then the ordered
list of its identifiers, about a sixtieth of its size, and only these lists are grouped and joined.

Defined results: null counts as empty, and all texts without other characters are equal; texts of any length
are cut and compared whole; of equal texts the one with the most code points stays, then the smallest id, null
ids last; of rows that repeat an id and a text one stays; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Bytes of a chunk, and how many bytes in a row decide a cut: on average 2 ** (WINDOW + 1) bytes after LEAST.
LEAST, MOST, WINDOW = 512, 8192, 8
#: White space that is no part of a text. Fixed values of the contract.
BLANKS = "\t\n\x0b\x0c\r "
#: Bytes of the groups that are broadcast at most, and rows of a group that is never broadcast.
HOT_BYTES, COLD_ROWS = 8 << 20, 64


def _cutting() -> str:
    """A pattern of one chunk. Bytes are dealt to the two halves by a bit of their multiplicative hash."""
    half = "".join(f"\\x{b:02x}" for b in range(256) if (b * 40503 >> 11) & 1)
    return f"(?s).{{{LEAST},{MOST}}}?(?:(?<=[{half}]{{{WINDOW}}})|\\z)|.{{1,{MOST}}}"


def without_blanks(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def chunks(normal: Column) -> Column:
    """The chunks of a text in order, its bytes written as the characters 0 to 255."""
    return F.regexp_extract_all(F.decode(F.encode(normal, "UTF-8"), "ISO-8859-1"), F.lit(_cutting()), F.lit(0))


def identifier(chunk: Column, words: int) -> Column:
    """``words`` hashes of 64 bits, each with a seed of its own."""
    return F.array(*(F.xxhash64(F.lit(k), chunk) for k in range(words)))


def chunk_store(df: DataFrame, text_col: str, words: int = 2, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """(identifier, chunk, n): each distinct chunk once, and how often it occurs. Equal chunks meet in each task first."""
    pieces = df.select(F.explode(chunks(without_blanks(F.col(text_col)))).alias("chunk"))
    return pieces.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).select(identify(F.col("chunk"), words).alias("identifier"), "chunk", "n")


def clashes(store: DataFrame) -> DataFrame:
    """Identifiers that unlike chunks share; identifiers alone travel."""
    return store.groupBy("identifier").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verified_words(df: DataFrame, text_col: str, identify: Callable[[Column, int], Column] = identifier) -> int:
    """So many words of identifiers that no two unlike chunks of the table share one; each try that fails doubles them."""
    words = 2
    while clashes(chunk_store(df, text_col, words, identify)).count():
        words *= 2
    return words


def recipes(df: DataFrame, id_col: str, text_col: str, words: int, identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """(id, chars, sha256, recipe): of each row the code points, the digest of the text without blanks, and its ordered identifiers."""
    normal = df.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("chars"), without_blanks(F.col(text_col)).alias("normal"))
    recipe = F.flatten(F.transform(chunks(F.col("normal")), lambda c: identify(c, words)))
    return normal.select("id", "chars", F.sha2(F.encode("normal", "UTF-8"), 256).alias("sha256"), recipe.alias("recipe"))


def exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify: Callable[[Column, int], Column] = identifier) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): a row for each of ``df``'s, with the row that stays of its group.

    Groups are made by their whole lists of identifiers. Rows of large groups meet theirs by a broadcast: those of over
    ``rows`` rows, where ``rows`` is the bytes of all lists over ``HOT_BYTES``, so that all of them together, one list
    each, take ``HOT_BYTES`` at most. The rows of all others are joined by a shuffle in which no group is larger.
    """
    lists = materialise(recipes(df, id_col, text_col, verified_words(df, text_col, identify), identify), "recipes")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id")).alias("best")
    found = lists.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best).filter("group_size > 1")
    groups = materialise(found.select("recipe", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars")), "copies")
    total = lists.agg(F.sum(F.size("recipe") * 8 + 64)).first()[0] or 0
    rows = max(COLD_ROWS, -(-total // HOT_BYTES))
    hot = F.broadcast(groups.filter(F.col("group_size") > rows))
    cold = groups.filter(F.col("group_size") <= rows).hint("shuffle_hash")
    met = lists.join(hot, "recipe").unionByName(lists.join(hot, "recipe", "left_anti").join(cold, "recipe", "left"))
    met = met.select("id", "sha256", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(F.col("group_size").isNotNull(), F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("first"))
    out = lambda rows_, keep, kept: rows_.select(F.col("id").alias(id_col), keep.alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"))
    alone = out(met.filter("first is null"), F.col("id"), F.lit(True))
    others = out(met.filter("not first"), F.col("keep_id"), F.lit(False))
    again = met.filter("first").groupBy("id", "sha256", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    return alone.unionByName(others).unionByName(out(again.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))), F.col("keep_id"), F.col("k") == 1))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``exact_copies`` drops; texts don't travel."""
    verdict = exact_copies(df, id_col, text_col).filter("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    here = df.withColumn("_own", F.sha2(F.encode(without_blanks(F.col(text_col)), "UTF-8"), 256))
    return here.join(verdict, here[id_col].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi").drop("_own")
