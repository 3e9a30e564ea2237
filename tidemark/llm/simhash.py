"""SimHash fingerprints (Charikar, 2002) and their near-duplicate classes through BK-trees.

1. Each text gets a 64-bit fingerprint from the XXH64 hashes of its word shingles.
2. Equal fingerprints collapse to one row before anything is compared.
3. Fingerprints within ``radius`` bits agree on at least two of ``radius + 2`` blocks of bits, so each
   is dealt to one shard for every pair of blocks. A shard is a set of fingerprints that agree on its
   two blocks. Shards over ``SHARD_MAX`` rows are dealt again by the bits not yet used, so a shard's
   size stays bounded whatever the data hold, and no link is lost.
4. In each shard a BK-tree (Burkhard and Keller, 1973) keeps children keyed by their integer Hamming
   distance to the parent; a search follows only the edges within the radius of the query's own
   distance. A shard returns one edge from each member to its class's smallest member, not all pairs.
5. Edges of all shards meet in connected components by alternating large-star and small-star steps
   (Kiveris et al., 2014), as joins and grouped minima.

Defined results: null or empty text, and text of white space alone, has fingerprint zero and links like
any other; texts of any length are hashed whole, a bounded number of shingles at a time; a null id takes part,
and its class's id is the smallest id that is not null; repeated rows are rows of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, keep_rows, materialise

SEED = 42
#: Fingerprints of one shard at most, before it is dealt again by further bits.
SHARD_MAX = 8192
#: Shards of at least so many fingerprints are searched with whole arrays of queries at a time.
_BATCHED = 24
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """The XXH64 hashes of the shingles of UTF-8 ``text``, a bounded number at a time; fewer words than ``width`` are
    one shingle. bytes.lower() and split() know ASCII only."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return
    whole = b" ".join(words)
    if n <= width:
        yield np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
        return
    length = np.fromiter(map(len, words), np.int64, n)
    del words
    end = np.cumsum(length + 1) - 1
    first, last, digest = (end - length)[: n - width + 1], end[width - 1 :], xxhash.xxh64_intdigest
    for at in range(0, len(first), _HASHES_AT_ONCE):
        part = slice(at, at + _HASHES_AT_ONCE)
        yield np.array([digest(whole[a:b], SEED) for a, b in zip(first[part].tolist(), last[part].tolist(), strict=True)], np.uint64)


def of_hashes(parts: Iterable[np.ndarray]) -> int:
    """The SimHash of shingle hashes: a bit is 1 if it is set in over half of them; 0 without any."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        total += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of UTF-8 ``text`` as an unsigned number."""
    return of_hashes(shingle_hashes(text, width))


def fingerprint_column(text: Column, width: int = 4) -> Column:
    """The fingerprint of a text column as a signed bigint."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_py() or b"", width) for x in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return simhash(F.coalesce(text, F.lit("")))


def as_hex(fp: Column) -> Column:
    """16 lower-case digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class BKTree:
    """A BK-tree over distinct 64-bit fingerprints, built by splitting arrays by distance to each node.

    The first of a set is its node; the others fall to the child keyed by their distance to it. That
    is the tree that inserting them one by one makes.
    """

    def __init__(self, fingerprints: np.ndarray):
        self.fps = fingerprints
        self.children: list[dict[int, int]] = [{} for _ in range(len(fingerprints))]
        self.root = 0
        sets = [np.arange(len(fingerprints))]
        while sets:
            own = sets.pop()
            node, rest = int(own[0]), own[1:]
            if not len(rest):
                continue
            distance = np.bitwise_count(fingerprints[rest] ^ fingerprints[node])
            order = np.argsort(distance, kind="stable")
            keys, starts = np.unique(distance[order], return_index=True)
            for key, part in zip(keys.tolist(), np.split(rest[order], starts[1:]), strict=True):
                self.children[node][key] = int(part[0])
                sets.append(part)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within the radius of it), following only edges that can lead there."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            distance = np.bitwise_count(queries[who] ^ self.fps[node]).astype(np.int16)
            if len(near := who[distance <= radius]):
                yield node, near
            for key, child in self.children[node].items():
                if len(go := who[np.abs(distance - key) <= radius]):
                    todo.append((child, go))


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _small_classes(fps: list[int], radius: int) -> list[int]:
    """Class numbers in a small shard: each fingerprint searches the BK-tree so far and is then inserted."""
    parent, children = list(range(len(fps))), [{} for _ in fps]
    for x in range(1, len(fps)):
        todo, place, free = [0], 0, False
        while todo:
            node = todo.pop()
            d = (fps[x] ^ fps[node]).bit_count()
            if d <= radius:
                a, b = _root(parent, x), _root(parent, node)
                parent[max(a, b)] = min(a, b)
            todo += [child for key, child in children[node].items() if abs(key - d) <= radius]
        while not free:
            d = (fps[x] ^ fps[place]).bit_count()
            free = d not in children[place]
            if free:
                children[place][d] = x
            else:
                place = children[place][d]
    return [_root(parent, x) for x in range(len(fps))]


def shard_classes(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of a shard's distinct fingerprints, the position of the first one of its class.

    Large shards grow classes from a seed, breadth first: the whole front is one array of queries.
    """
    if len(fps) < _BATCHED:
        return np.array(_small_classes(fps.tolist(), radius))
    tree, of = BKTree(fps), np.full(len(fps), -1, np.int64)
    for seed in range(len(fps)):
        if of[seed] >= 0:
            continue
        of[seed], front = seed, np.array([seed])
        while len(front):
            found = []
            for node, _ in tree.search(fps[front], radius):
                if of[node] < 0:
                    of[node] = seed
                    found.append(node)
            front = np.array(found, np.int64)
    return of


def _links(radius: int):
    """Over batches sorted by shard: (a, b) from each member to the first member of its class, where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            a, b = [], []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                own = np.unique(fps[s:e])
                first = own[shard_classes(own, radius)]
                differ = first != own
                a.append(own[differ])
                b.append(first[differ])
            cat = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield done(keys[:cut], fps[:cut])
                    keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield done(keys, fps)

    return run


def _bits(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(first: int, bits: int, parts: int) -> list[tuple[int, int]]:
    """(start, width) of ``parts`` blocks, as even as can be, of ``bits`` bits from bit ``first``."""
    cuts = [first + bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _dealt(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, fingerprint), a row for each pair of blocks, with oversized shards dealt again.

    A level that deals again splits the fingerprint into radius + 1 other blocks, of which close
    fingerprints share one, and adds that block to the shard's key; sizes fall with each level.
    """
    fp = F.col("fingerprint")
    blocks = _blocks(0, 64, radius + 2)
    pairs = [(x, y) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]
    keys = [F.xxhash64(F.lit(i), _bits(fp, *x), _bits(fp, *y)) for i, (x, y) in enumerate(pairs)]
    rows = fps.select(F.explode(F.array(*keys)).alias("shard"), "fingerprint")
    settled, many = [], fps.count() > SHARD_MAX
    for level in range(1, 5):
        if not many:
            break
        large = rows.groupBy("shard").count().filter(F.col("count") > SHARD_MAX).select("shard")
        large = materialise(large, "large-shards")
        if large.isEmpty():
            break
        settled.append(rows.join(large, "shard", "left_anti"))
        turned = F.shiftleft(fp, 5 * level).bitwiseOR(F.shiftrightunsigned(fp, 64 - 5 * level))
        finer = [F.xxhash64(F.lit(level), F.col("shard"), F.lit(i), _bits(turned, *x)) for i, x in enumerate(_blocks(0, 64, radius + 1))]
        rows = materialise(rows.join(large, "shard", "left_semi").select(F.explode(F.array(*finer)).alias("shard"), "fingerprint"), "dealt-again")
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def close_pairs(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` bits, at most one a member and shard."""
    dealt = _dealt(fps, radius)
    by_shard = dealt.repartition("shard").sortWithinPartitions("shard")
    return by_shard.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` but the roots; a root is the smallest node it reaches.

    Each round links every node to the smallest of its neighbours: first the larger neighbours of
    each node, then the smaller ones. The join of edges with grouped minima splits at a hot node.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def classes_of(rows: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, root, component_id) of each distinct fingerprint of ``rows`` (id, fingerprint)."""
    own = materialise(rows.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    roots = components(close_pairs(own.select("fingerprint"), radius))
    of = own.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fingerprint", "root", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """A row for each row of ``df``: its id, fingerprint (hex), component_id (the smallest id of its class)."""
    rows = materialise(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fingerprint")), "fingerprints")
    return rows.join(classes_of(rows, radius), "fingerprint").select(F.col("id").alias(id_col), as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each near-duplicate class: of those with the class's id, the one whose text has the least
    hash. Rows with a null id stay; unlike texts that share an id are in classes of their own."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("place"), fingerprint_column(F.col(text_col), width).alias("fingerprint"))
    rows = materialise(rows, "fingerprints")
    return keep_rows(df, rows.join(classes_of(rows, radius), "fingerprint").select("id", "place", "root"), id_col, text_col)
