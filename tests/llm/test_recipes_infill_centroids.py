"""Exact dedup by chunk recipes, fill-in-middle and bounded k-means against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from conftest import SMALL
from pyspark.sql import functions as F

from tidemark.llm import centroids, infill, queries, recipes

BLANK = r"[\x20\x09-\x0D]"
DOC = "doc_id long, text string, chunk string, id string, recipe string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], schema)


def plain_groups(rows):
    """(doc_id, keep_id, size, kept) in any order, of rows that are all unlike in id."""
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(BLANK, "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1], sha(k)) for k, g in by.items() for _, i in g)


def long_text(seed, words=4000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopé漢") for _ in range(rng.randint(1, 9))) for _ in range(words))


def edge_texts():
    one = long_text(1)
    return [
        (1, None), (2, ""), (3, " \n\t"), (4, one), (5, one.replace(" ", "\n ")), (6, one + "x"), (7, "x" + one), (8, "a b"), (9, "ab"), (10, "a b"),
        (11, "a" * 50_000), (12, "a" * 49_999 + " a"), (13, "a" * 49_999), (14, "<P> a b"), (15, "  lead and trail  "), (16, "\U0001f600 漢字 z"), (17, "a\x00b c"),
    ]


def found_groups(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_recipes_group_equal_texts(spark):
    rows = edge_texts()
    assert found_groups(recipes.exact_copies(frame(spark, rows))) == plain_groups(rows)


def test_recipes_survive_clashing_identifiers_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(recipes, "COLD_ROWS", 3)
    weak = lambda c, words: F.array(F.length(c).cast("long")) if words < 8 else recipes.identifier(c, words)
    rows = edge_texts() + [(100 + i, "the same " + " " * i) for i in range(9)]
    df = frame(spark, rows)
    assert recipes.verified_words(df, "text", weak) == 8
    assert found_groups(recipes.exact_copies(df, identify=weak)) == plain_groups(rows)


def test_recipes_null_ids_repeats_and_empty(spark):
    df = frame(spark, [(None, "a"), (7, "a "), (7, "a "), (7, " b"), (None, "c"), (None, "c")])
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in recipes.exact_copies(df).collect()), key=str)
    assert got == sorted([(None, 7, 3, False), (7, 7, 3, True), (7, 7, 3, False), (7, 7, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert recipes.exact_copies(df.limit(0)).collect() == []
    assert sorted((r.doc_id, r.text) for r in recipes.keep_one(frame(spark, [(1, "a"), (2, "a"), (3, "b")])).collect()) == [(1, "a"), (3, "b")]


def test_chunks_follow_content(spark):
    """A byte put in front changes the first chunks only, and all chunks join to the text."""
    text = long_text(3, 20_000)
    row = spark.createDataFrame([(text,)], "t string").select(*(recipes.chunks(recipes.without_blanks(c)).alias(n) for n, c in (("a", F.col("t")), ("b", F.concat(F.lit("q"), "t"))))).first()
    assert "".join(row.a).encode("latin-1").decode() == text.replace(" ", "")
    assert len(row.a) > 40 and len(set(row.a) - set(row.b)) <= 2
    assert all(len(c) <= recipes.MOST for c in row.a) and all(len(c) >= recipes.LEAST for c in row.a[:-1])


def test_recipes_query_is_native(spark):
    plan = queries.op11_recipes(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_infill(i, text, seed=42):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(sha(f"{seed}:{i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_against_brute_force(spark):
    texts = [t for _, t in edge_texts()] + ["<", "S> <P", "a <", "a>", "\n", " x"]
    rows = [(i, texts[i % len(texts)]) for i in range(400)]
    made = infill.fill_in_middle(frame(spark, rows))
    got = {r.doc_id: r for r in made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()}
    for i, t in rows:
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars, got[i].output) == plain_infill(i, t), (i, t)
        assert got[i].back == (t or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}
    assert made.limit(0).collect() == [] and infill.fill_in_middle(frame(spark, rows).limit(0)).collect() == []


def test_infill_null_id_and_slices(spark, monkeypatch):
    row = infill.fill_in_middle(frame(spark, [(None, "a b c")])).first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plain_infill("null", "a b c")
    monkeypatch.setattr(infill, "SLICE", 16)
    texts = ["one two  three", "", "   ", "x", "漢 字\n", "w " * 3000]
    first, second = np.array([5, 1, 1, 0, 1, 2000]), np.array([3, 7, 0, 1, 2, 999])
    found = infill.cuts(pa.array(texts).cast(pa.binary()), first, second)
    for k, t in enumerate(texts):
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        a, b = sorted((first[k] % (len(tokens) + 1), second[k] % (len(tokens) + 1)))
        assert found["n"][k] == len(tokens)
        assert (found["first_cut"][k], found["second_cut"][k]) == tuple(len("".join(tokens[:x]).encode()) for x in (a, b))
        assert (found["prefix_chars"][k], found["middle_chars"][k]) == (len("".join(tokens[:a])), len("".join(tokens[a:b])))


def test_rank_and_select_on_random_bits():
    rng = np.random.default_rng(2)
    for share in (0.001, 0.3, 1.0):
        bits = rng.random(5003) < share
        index = infill.RankSelect(np.packbits(bits))
        at = np.arange(len(bits) + 1)
        assert (index.rank(at) == np.concatenate([[0], bits.cumsum()])).all()
        assert (index.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def plain_clusters(rows, k, rounds, dim, scale=1024):
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    centres = [list(v) for _, v in sorted(kept, key=lambda r: (sha(f"3:{'null' if r[0] is None else r[0]}"), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else centres[j]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = [sum(d for _, j, d in out if j == c) for c in range(len(centres))]
    digests = [sha(",".join(map(str, c))) for c in centres]
    return sorted(((i, j, d, by[j], sum(by), digests[j]) for i, j, d in out), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, ids int")


def test_centroids_query_against_plain_rounds(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert as_rows(queries.op13_centroids(spark, SMALL)) == plain_clusters(rows, 8, 10, 64)


def test_centroids_ties_repeats_and_other_numbers(spark):
    rng = np.random.default_rng(4)
    grid = [(i, rng.integers(0, 3, 4) / 1024) for i in range(300)]
    for k, rounds in ((16, 4), (5, 0), (2, 6), (1, 3)):
        got = centroids.clusters(vectors(spark, grid), k=k, rounds=rounds, dim=4)
        assert as_rows(got) == plain_clusters(grid, k, rounds, 4)


def test_centroids_leave_out_what_is_not_whole(spark):
    ok = [0.5, -0.25, 1e3, 0.0]
    rows = [(1, ok), (2, None), (3, [1.0, 2.0]), (4, [1.0, None, 0.0, 0.0]), (5, [float("nan")] * 4), (6, [float("inf"), 0, 0, 0]), (None, [0.1] * 4), (8, ok), (8, ok)]
    assert as_rows(centroids.clusters(vectors(spark, rows), k=3, dim=4)) == plain_clusters(rows, 3, 10, 4)
    assert centroids.clusters(vectors(spark, rows[1:6]), dim=4).collect() == []


def test_bounds_rule_out_most_distances(spark):
    """Bounds that certify keep a vector from any distance, and narrowing keeps results exact."""
    rng = np.random.default_rng(9)
    spots = rng.integers(-4000, 4000, (12, 8))
    points = (spots[rng.integers(0, 12, 2000)] + rng.integers(-60, 60, (2000, 8))).astype(np.int64)
    centres = spots.astype(np.int64)
    block, counted = centroids.Bounds.fresh(points, centres, 3), 0
    whole = centroids.Bounds._distance
    for step in range(5):
        moved = centres + rng.integers(-5, 6, centres.shape)
        needed = block.moved(moved, np.sqrt(((moved - centres) ** 2).sum(1).astype(float)) * (1 + centroids.MARGIN))
        block, centres = block.narrowed(max(2, needed)), moved
        exact = np.stack([whole(points, c) for c in centres], 1)
        assert (block.near[:, 0] == exact.argmin(1)).all()
        counted += needed
    assert counted == 0 and block.listed == 2


def test_sketches_let_every_near_copy_through(spark):
    """Sets on both sides of a doubling of the sketch's width: no pair of similarity 0.8 is ruled out, most unlike ones are."""
    from tidemark.llm import nearcopies

    rng = random.Random(3)
    texts = []
    for n in (3, 60, 62, 66, 127, 130, 500, 520):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        texts += [" ".join(base), " ".join(base + [f"e{k}" for k in range(n // 10)]), " ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sets = df.select(nearcopies.signature_column(F.col("text"), 5, nothing).alias("d")).select("d.*").dropDuplicates(["key"]).cache()
    pairs = sets.select(F.col("key").alias("a")).crossJoin(sets.select(F.col("key").alias("b"))).filter("a < b").cache()
    got = {(r.a, r.b) for r in nearcopies._hopeful(pairs, sets).collect()}
    own = {nearcopies._key(s): set(s.tolist()) for s in (nearcopies.shingle_set(t.encode()) for t in texts)}
    near = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) * 5 >= 4 * len(own[a] | own[b])}
    assert near <= got and len(near) >= 7 and len(got) <= len(near) + 2


def test_a_token_behind_the_first_few_meets_smaller_sets_only(spark):
    from tidemark.llm import nearcopies

    met = lambda rows: nearcopies._pairs_apart(*nearcopies._by_size(spark.createDataFrame([(1, i, n, at, i) for i, (n, at) in enumerate(rows)], "token long, key long, n int, at int, root long")))
    assert met([(30, 4)] * 200) == 0
    assert met([(30, 0)] * 20) == 380
    assert met([(30, 4), (24, 0)]) == 1
