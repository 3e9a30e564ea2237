"""Near copies for a pipeline: SimHash proposes, exact Jaccard similarity of word shingles decides, none is missed.

1. One pass gives each text's SimHash and the set of its shingles' hashes, ``width`` words each. Texts with equal
   sets collapse to one key before anything is compared.
2. Fingerprints within ``radius`` bits are found through BK-trees (``simhash.close_pairs``), and propose pairs of sets.
3. SimHash misses most pairs near 0.8 at any radius that can be searched, so the other proposals are exact: two sets of
   similarity 0.8 or more share a token among the first ``n - ceil(0.8 n) + 1`` of each, in any one order of
   tokens (Chaudhuri, 2006); common tokens come last, and only these prefixes are dealt by token. A pair must be
   able to reach the needed overlap from the places of its common token (Xiao, 2008).
4. First each set is compared with the least one of each of its tokens, so that a group of copies costs one pair a
   member. Where large groups are still apart, each set is compared with a few drawn for each of its tokens. Then
   all pairs that these links have not joined are compared, and only tokens that still hold two classes are read. A pair meets
   at a token and a class of sizes: how far behind a token lies in the larger set says how small the other must be, so a
   notice that many texts share brings together those only that it could make near copies.
   A sketch of each set rules out the proposals that can't reach the overlap, and every other one is verified by the
   exact size of the intersection.

Defined results: null, empty and blank texts have the empty set and are copies of each other; texts of any length are
read whole; a text of fewer words than ``width`` is one shingle; a null id takes part, and rows with it stay; repeated
rows are copies; an empty table gives an empty result; extra columns, whatever their names, pass through.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, give_back, keep_rows, materialise, small
from .simhash import SEED, close_pairs, components, of_hashes, shingle_hashes

#: A token in so many of the texts read in a row, up to ``_HELD`` tokens of them, is common; at most ``_COMMON`` tokens
#: are ordered by their counts. The order decides how many pairs are compared, not the result.
_OFTEN, _HELD, _COMMON = 6, 1 << 20, 1 << 18
#: While the tokens hold more pairs of different classes than ``_PAIRS_A_ROW`` a row, each set is compared first
#: with ``_DRAWN`` ones of each of its tokens, drawn by hash.
_PAIRS_A_ROW, _DRAWN = 32, 24
#: Bits of the sketch that says at most how many tokens two sets can share: four to eight a token, so many at least.
_BITS = 256


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles in order."""
    return _distinct(list(shingle_hashes(text, width)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _key(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), SEED)).view(np.int64))


def common_tokens(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, their counts) of those that many texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = counts >= _OFTEN
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "c"])

        sets: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                sets.append(shingle_set(x.as_py() or b"", width))
                held += len(sets[-1])
                if held > _HELD:
                    yield often()
                    sets, held = [], 0
        yield often()
        sets = []
        give_back()

    counted = texts.mapInArrow(run, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.desc("c"), "token").limit(_COMMON).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["c"].to_numpy(np.int64)[order]


def signature_column(text: Column, width: int, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """struct of each set's key, its size, the text's SimHash, the prefix of the set's tokens and a sketch of the set, in
    which the bit of each token's hash is set."""
    known, counts = common

    @F.arrow_udf("struct<key:bigint,n:int,fingerprint:bigint,prefix:array<bigint>,sketch:array<bigint>>")
    def signature(texts: pa.Array) -> pa.Array:
        keys, sizes, prints, ends, parts, sketches, wide = [], [], [], [0], [], [], [0]
        for x in texts.cast(pa.binary()):
            hashes = list(shingle_hashes(x.as_py() or b"", width))
            prints.append(of_hashes(hashes))
            tokens = _distinct(hashes)
            n = len(tokens)
            first = n - (4 * n + 4) // 5 + 1 if n else 0
            rank = np.zeros(n, np.int64)
            if len(known) and n:
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                rank = np.where(known[at] == tokens, counts[at], 0)
            parts.append(tokens[np.argsort(rank, kind="stable")[:first]])
            bits = np.zeros(max(_BITS, 1 << (4 * n - 1).bit_length()) if n else _BITS, bool)
            bits[(tokens >> np.uint64(24)) % np.uint64(len(bits))] = True
            sketches.append(np.packbits(bits).view(np.int64))
            wide.append(wide[-1] + len(sketches[-1]))
            keys.append(_key(tokens))
            sizes.append(n)
            ends.append(ends[-1] + first)
        values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists]
        sketch = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64))
        columns.append(pa.ListArray.from_arrays(pa.array(wide, pa.int32()), sketch))
        out = pa.StructArray.from_arrays(columns, ["key", "n", "fingerprint", "prefix", "sketch"])
        give_back()
        return out

    return signature(F.coalesce(text, F.lit("")))


def set_column(text: Column, width: int) -> Column:
    """The tokens of a text."""

    @F.arrow_udf("array<bigint>")
    def tokens(texts: pa.Array) -> pa.Array:
        out = pa.array([shingle_set(x.as_py() or b"", width).view(np.int64) for x in texts.cast(pa.binary())], pa.list_(pa.int64()))
        give_back()
        return out

    return tokens(F.coalesce(text, F.lit("")))


def _possible(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether two sets whose first common token lies at these places can have similarity 0.8."""
    return F.least(n - at, other_n - other_at) * 9 >= (n + other_n) * 4


def _hopeful(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a similarity of 0.8: sets share at most the bits that both have set, and the
    tokens of the one that has fewer of them hidden behind a bit that another token has set. A wider sketch is folded to
    the width of the other."""
    ones = lambda c: F.aggregate(c, F.lit(0), lambda total, x: total + F.bit_count(x))
    own = lambda side: sets.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    both = own("b").join(small(pairs), "b").join(own("a"), "a")
    width = F.least(F.size("sa"), F.size("sb"))

    def folded(c: str) -> Column:
        word = lambda k: F.aggregate(F.sequence(k, F.size(c) - 1, width), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.get(F.col(c), i)))
        return F.when(F.size(c) == width, F.col(c)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), word))

    both = both.select("a", "b", "na", "nb", folded("sa").alias("sa"), folded("sb").alias("sb"))
    hidden = F.least(F.col("na") - ones("sa"), F.col("nb") - ones("sb"))
    shared = ones(F.zip_with("sa", "sb", lambda x, y: x.bitwiseAND(y))) + hidden
    return both.filter(shared * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b")


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, width: int, keep: Scratch) -> DataFrame:
    """The pairs (a, b) of keys whose sets have a similarity of 0.8 or more. One text of each key is read again: its
    tokens go to the pairs that it is ``b`` of, and those of each ``a`` meet them by one shuffle."""
    sides = []
    for side in ("a", "b"):
        wanted = keep(pairs.select(F.col(side).alias("key")).distinct(), f"wanted-{side}")
        own = rows.join(small(wanted), "key", "left_semi").groupBy("key").agg(F.min("copy").alias("copy"))
        met = texts.join(small(keep(own, f"texts-{side}")), "copy")
        sides.append(met.select(F.col("key").alias(side), set_column(F.col("text"), width).alias(f"t{side}")))
    both = sides[1].join(small(pairs), "b").join(sides[0], "a")
    size = F.size("ta") + F.size("tb")
    return keep(both.filter(F.size(F.array_intersect("ta", "tb")) * 9 >= size * 4).select("a", "b").distinct(), "near-copies")


def _distinct_sets(rows: DataFrame, keep: Scratch) -> DataFrame:
    """One row of each key; only rows of keys that occur again are shuffled."""
    again = small(keep(rows.groupBy("key").count().filter("count > 1").select("key"), "keys-again"))
    sets = rows.select("key", "n", "fingerprint", "prefix", "sketch")
    return sets.join(again, "key", "left_anti").unionByName(sets.join(again, "key", "left_semi").dropDuplicates(["key"]))


def _simhash_pairs(sets: DataFrame, radius: int, keep: Scratch) -> DataFrame:
    """(a, b) of keys that SimHash proposes: each key with the least one of its fingerprint, and these with that of the
    fingerprint that a BK-tree's shard links them to."""
    least = keep(sets.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct-fingerprints")
    links = close_pairs(least.select("fingerprint"), radius)
    own = sets.join(least, "fingerprint").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    of = lambda fp, key: least.select(F.col("fingerprint").alias(fp), F.col("least").alias(key))
    far = links.withColumnsRenamed({"a": "fa", "b": "fb"}).join(of("fa", "a"), "fa").join(of("fb", "b"), "fb").select("a", "b")
    return own.unionByName(far)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (token, key, n, at) of tokens that still hold two classes, each with the root of its class."""
    token = Window.partitionBy("token")
    of = dealt.select("token", "key", "n", "at").join(small(roots), F.col("key") == F.col("node"), "left").select("token", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    return of.withColumns({"low": F.min("root").over(token), "high": F.max("root").over(token)}).filter("low <> high").drop("low", "high")


def _class(n: Column) -> Column:
    """Classes of sizes, each a tenth wide."""
    return F.floor(F.log(n.cast("double")) / F.lit(np.log(1.1))).cast("int")


def _by_size(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``apart`` twice, with a class of sizes: as the larger set of a pair, once for each class of sizes that the
    other can have, and as the smaller one in its own class. From place ``at`` on, a set of n tokens reaches 0.8 only with sets of
    at most 9 (n - at) / 4 - n tokens, so a token behind the first few of a set meets sets much smaller than it only."""
    n, at = F.col("n"), F.col("at")
    low, high = F.ceil(n * 4 / 5), F.least(n, F.floor((n - at) * 9 / 4) - n)
    larger = apart.filter(high >= F.greatest(low, F.lit(1))).withColumn("size", F.explode(F.sequence(_class(low), _class(high))))
    return larger, apart.withColumn("size", _class(n))


def _pairs_apart(larger: DataFrame, smaller: DataFrame) -> float:
    """How many pairs of different classes the tokens and sizes hold, counted from the sizes of the classes at each."""
    keys = ["token", "size"]
    sides = larger.select(*keys, "root", F.lit(1.0).alias("l"), F.lit(0.0).alias("s")).unionByName(smaller.select(*keys, "root", F.lit(0.0).alias("l"), F.lit(1.0).alias("s")))
    of = sides.groupBy(*keys, "root").agg(F.sum("l").alias("l"), F.sum("s").alias("s")).groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.sum(F.col("l") * F.col("s")).alias("own"))
    return of.agg(F.sum(F.col("l") * F.col("s") - F.col("own"))).first()[0] or 0.0


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """(id, place, root) for each row of ``df``: place is the hash of its text, root the key of its class of near copies."""
    with Scratch(df.sparkSession) as keep:
        return materialise(_classes(df, id_col, text_col, width, radius, keep), "classes")


def _classes(df: DataFrame, id_col: str, text_col: str, width: int, radius: int, keep: Scratch) -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    place = F.xxhash64(text)
    texts = df.select(F.xxhash64(F.col(id_col), place).alias("copy"), text.alias("text"))
    common = common_tokens(texts.select("text"), width)
    made = df.select(F.col(id_col).alias("id"), place.alias("place"), F.xxhash64(F.col(id_col), place).alias("copy"), signature_column(F.col(text_col), width, common).alias("d"))
    rows = keep(made.select("id", "place", "copy", "d.*"), "signatures")
    sets = _distinct_sets(rows, keep)
    token = Window.partitionBy("token")
    dealt = sets.select("key", "n", F.posexplode("prefix").alias("at", "token"))
    least = F.min(F.struct("key", "n", "at")).over(token)
    shared = dealt.select("token", "key", "n", "at", least.alias("hub"), F.max("key").over(token).alias("last")).filter("hub.key <> last")
    shared = keep(shared.drop("last"), "shared-tokens")
    to_hub = shared.filter((F.col("key") != F.col("hub.key")) & _possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at")))
    star = to_hub.select(F.col("hub.key").alias("a"), F.col("key").alias("b")).unionByName(_simhash_pairs(sets.select("key", "fingerprint"), radius, keep))
    star = keep(_ordered(star).distinct(), "star-pairs")
    edges = _verified(keep(_hopeful(star, sets), "hopeful-star"), rows, texts, width, keep)
    apart = keep(_apart(shared, keep(components(edges), "star-classes")), "tokens-apart")
    if _pairs_apart(*_by_size(apart)) > _PAIRS_A_ROW * apart.count():
        drawn = F.array(*(F.min(F.struct(F.xxhash64("key", "token", F.lit(k)).alias("draw"), "key", "n", "at", "root")).over(token) for k in range(_DRAWN)))
        met = apart.withColumn("hubs", drawn).select("key", "n", "at", "root", F.explode("hubs").alias("hub")).filter("root <> hub.root")
        met = met.filter(_possible(F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"))).select(F.col("hub.key").alias("a"), F.col("key").alias("b"))
        more = keep(_ordered(met).distinct().join(star, ["a", "b"], "left_anti"), "star-pairs")
        edges = keep(edges.unionByName(_verified(keep(_hopeful(more, sets), "hopeful-star"), rows, texts, width, keep)), "star-links")
        star = star.unionByName(more)
        apart = keep(_apart(apart, keep(components(edges), "star-classes")), "tokens-apart")
    larger, smaller = _by_size(apart)
    other = smaller.select("token", "size", *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "at", "root")))
    first = (F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("key_b") < F.col("key")))
    cross = first & (F.col("root") != F.col("root_b")) & _possible(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b"))
    met = larger.join(other, (larger["token"] == other["token"]) & (larger["size"] == other["size"]) & cross)
    pairs = _ordered(met.select(F.col("key").alias("a"), F.col("key_b").alias("b"))).distinct()
    pairs = keep(pairs.join(star, ["a", "b"], "left_anti"), "cross-pairs")
    more = _verified(keep(_hopeful(pairs, sets), "hopeful-pairs"), rows, texts, width, keep)
    roots = keep(components(edges.unionByName(more)), "all-classes")
    of = rows.select("id", "place", "key").join(small(roots), F.col("key") == F.col("node"), "left")
    return of.select("id", "place", F.coalesce("root", "key").alias("root"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``df`` with one row of each class of near copies: the one with the smallest id. Rows with a null id stay."""
    return keep_rows(df, jaccard_classes(df, id_col, text_col, width), id_col, text_col)
