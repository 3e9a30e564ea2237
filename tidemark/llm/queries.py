"""Registered queries of this subpackage, one for each operator, over whole tables, and their SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, chat, decontam, html, infill, langid, pii, recipes, sharding, simhash, warc
from .shared import shared_dir, small_batches

SHARDS = 24


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on every machine; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", pii.span_digests(F.col("text")).alias("d"))
    return docs.select("doc_id", "d.*")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    return warc.rebuilt(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: A conversation whose texts hold the template's own marks.
FORGED = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = spark.createDataFrame([(-7, 0, "user", FORGED), (-7, 1, "assistant", FORGED)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged)
    return chat.read_back(chat.format_windows(rows))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs.select("doc_id", "text"), docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", bpe.digest_column(F.col("text"), tokenizer_path()).alias("d"))
    return docs.select("doc_id", "d.*")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_copies(_table(spark, sf_dir, "documents"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_pii, op3_ann, op4_warc, op5_html, op6_chat, op7_langid, op8_sharding, op9_bpe, op10_decontam, op11_recipes, op12_infill, op13_centroids)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * (i // 8)}, 10))::UBIGINT >> {35 - 5 * (i % 8)}) & 31)::INT, 1)" for i in range(32)
)


def _lloyd(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Plain rounds of assignment and integer means, one table each."""
    away = "list_sum(list_transform(range(1, %d), lambda i: (v[i] - c[i]) * (v[i] - c[i])))" % (dim + 1)
    parts = [
        f"p as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as j, v as c from (select v, sha256('3:' || vec_id) as h from p order by h, v limit {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} as materialized (select vec_id, v, min(row(d, j)) as m from (select vec_id, v, j, {away}::bigint as d from p cross join c{n}) group by vec_id, v)")
        if n < rounds:
            parts.append(f"s{n} as (select j, i, sum(x)::bigint as t, count(*) as n from (select struct_extract_at(m, 2) as j, unnest(v) as x, unnest(range(1, {dim + 1})) as i from a{n}) group by j, i)")
            parts.append(f"c{n + 1} as materialized (select c{n}.j, coalesce(x, c{n}.c) as c from c{n} left join (select j, list((case when t >= 0 then t // n else -((-t + n - 1) // n) end)::bigint order by i) as x from s{n} group by j) using (j))")
    last = f"select vec_id, struct_extract_at(m, 2)::int as cluster, struct_extract_at(m, 1)::bigint as distance from a{rounds}"
    return (
        "with " + ",\n".join(parts) + f", f as ({last})\nselect vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, "
        f"sha256(array_to_string(c, ',')) as centroid_sha256 from f join c{rounds} on c{rounds}.j = f.cluster"
    )


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can say; the others are tested against brute force."""
    return {
        "op11_recipes": r"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over g as keep_id, (count(*) over (partition by text_sha256))::bigint as group_size, row_number() over g = 1 as kept, text_sha256
from d window g as (partition by text_sha256 order by n desc, doc_id rows between unbounded preceding and unbounded following)""",
        "op12_infill": r"""
with d as (select doc_id, coalesce(text, '') as x, sha256('42:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t, ('0x' || h[1:8])::ubigint::bigint as h1, ('0x' || h[9:16])::ubigint::bigint as h2, ('0x' || h[17:24])::ubigint::bigint as h3, ('0x' || h[25:32])::ubigint::bigint as h4 from d),
w as (select *, len(t) as n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) as a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) as b from u),
z as (select *, array_to_string(t[1:a], '') as p, array_to_string(t[a + 1:b], '') as m, array_to_string(t[b + 1:n], '') as s,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from w)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(x) as restored_sha256
from z""",
        "op13_centroids": _lloyd(),
        "op4_warc": f"""
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
r as (select *, max(page_id) over (partition by b) as top from p)
select page_id, octet_length(b)::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to, true as verified
from r""",
        "op10_decontam": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as g, least(10, len(w)) as n from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
lens as (select distinct n from win),
grams as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)),
m as (select distinct doc_id, item_id, s, grams.n as n from grams join win using (g, n)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from m) group by 1),
its as (select doc_id, count(*) as n_items, sha256(string_agg(i, ',' order by i)) as h from (select distinct doc_id, item_id::varchar as i from m) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join its using (doc_id)""",
    }
