"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations alone.

1. Test items are cut into windows of ``window`` words (a shorter item is one window). Equal windows of
   several items are one window.
2. The document frequency of each test term is counted over all documents.
3. Each window is anchored at its rarest term. The index holds the postings of anchor terms: term,
   document, position, and the terms around that position, as many as a window can reach.
4. A posting meets the windows that its term anchors, shifted by the term's offset in the window, and the
   further lists of the window are intersected at their own offsets: term by term, the word at each
   adjusted position must be the window's. What is left are exact phrase matches.
5. Matches of one document merge into intervals, whose lengths are the words that were hit.

``proximity_matches`` uses the same index for terms that occur within a distance, in any order.

The lookups by anchor term broadcast only if the table of windows is within ``BROADCAST_ROWS`` rows,
by a count; beyond that they are shuffle joins, which split at hot terms.

Defined results: null text, and text without a word, has no words and no hits; items without words match
nothing; repeated items share their windows and each count; rows that repeat a document id are told
apart only by their texts, so such rows get results of their own; an empty benchmark leaves all clean.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_names, materialise, small

WINDOW = 10
#: Rows of the table of windows up to which it is broadcast; a row has about 200 bytes.
BROADCAST_ROWS = 50_000

# What parts words, and the letters that are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(parts, "")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, terms): every window of every item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("start")
    return items.select("item", "w", starts).select("item", F.slice("w", F.col("start"), window).alias("terms")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _anchored(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(terms, n, anchor, offset) for each distinct window, anchored at its rarest term."""
    distinct = windows.select("terms").distinct()
    vocabulary = materialise(distinct.select(F.explode("terms").alias("term")).distinct(), "test-terms")
    met = documents.select(F.explode(F.array_distinct("w")).alias("term")).join(_small(vocabulary), "term")
    counted = materialise(met.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "test-term-frequencies")
    frequency = vocabulary.join(small(counted), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    placed = distinct.select("terms", F.posexplode("terms").alias("offset", "term")).join(small(frequency), "term")
    rarest = placed.groupBy("terms").agg(F.min_by(F.struct("term", "offset"), F.struct("df", "offset")).alias("a"), F.min("df").alias("df"))
    return rarest.filter("df > 0").select(F.xxhash64("terms").alias("window_id"), "terms", F.size("terms").alias("n"), F.col("a.term").alias("term"), F.col("a.offset").alias("offset"))


def postings(documents: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(doc, term, pos, from, around) for each place of a term of ``terms``, ``around`` being the words
    from position ``from`` to ``reach`` - 1 places after ``pos``."""
    placed = documents.select("doc", "w", F.posexplode("w").alias("pos", "term"))
    first = F.greatest(F.col("pos") - (reach - 1), F.lit(0))
    columns = ("doc", "term", "pos", first.alias("from"), F.slice("w", first + 1, F.col("pos") - first + reach).alias("around"))
    if terms.count() <= BROADCAST_ROWS:
        return placed.join(F.broadcast(terms), "term").select(*columns)
    return placed.select(*columns).join(terms, "term")  # only the neighbourhood of each word is shuffled


def phrase_matches(documents: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """(doc, window_id, start, end) of each exact occurrence; ``documents`` has doc and w (its words)."""
    anchored = materialise(_anchored(documents, windows), "anchored-windows")
    index = postings(documents, anchored.select("term").distinct(), window)
    candidates = index.join(_small(anchored), "term")
    start = F.col("pos") - F.col("offset")
    same = F.slice("around", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("n")) == F.col("terms")
    return candidates.filter((start >= 0) & same).select("doc", "window_id", start.alias("start"), (start + F.col("n")).alias("end"))


def _covered(matches: DataFrame) -> DataFrame:
    """(doc, n_hit): the length of the union of each document's intervals."""
    spans = matches.groupBy("doc", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("doc").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """A row for each document: its id, n_words, n_hit, n_items, items_sha256, contaminated."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    tokens = documents.select(key.alias("doc"), words(F.col(text_col)).alias("w"))
    windows = materialise(item_windows(benchmark, item_col, item_text, window), "test-windows")
    matches = materialise(phrase_matches(tokens, windows, window), "phrase-matches")
    named = windows.select("item", F.xxhash64("terms").alias("window_id"))
    items = matches.select("doc", "window_id").distinct().join(named, "window_id").select("doc", "item").distinct()
    listed = items.groupBy("doc").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    hit = _covered(matches).join(listed, "doc")
    rows = tokens.select("doc", F.size("w").cast("long").alias("n_words")).join(hit, "doc", "left")
    return rows.select(
        F.col("doc.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``documents`` without the rows that hold a window of a test item; the others pass whole."""
    (name,) = free_names(documents, "doc")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    windows = materialise(item_windows(benchmark, item_col, item_text, window), "test-windows")
    found = phrase_matches(documents.select(key.alias("doc"), words(F.col(text_col)).alias("w")), windows, window)
    hit = materialise(found.select(F.col("doc").alias(name)).distinct(), "contaminated")
    return documents.withColumn(name, key).join(small(hit), name, "left_anti").select(*documents.columns)


def proximity_matches(documents: DataFrame, queries: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, doc id, pos): places where all terms of a query (query, terms) lie within ``within`` words.

    The place is that of the query's rarest term, and the others lie in the ``within`` words around it
    on either side. Terms may come in any order.
    """
    tokens = documents.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("w"))
    wanted = queries.select("query", F.array_distinct("terms").alias("terms")).filter(F.size("terms") > 0)
    anchored = _anchored(tokens, wanted).select("window_id", "terms", "term")
    index = postings(tokens, anchored.select("term").distinct(), within)
    found = index.join(anchored, "term").filter(F.size(F.array_except("terms", "around")) == 0)
    return found.select("window_id", "doc", "pos").join(wanted.select("query", F.xxhash64("terms").alias("window_id")), "window_id").select("query", F.col("doc").alias(id_col), "pos")
