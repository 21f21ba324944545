"""Queries over splits, picks, batches and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from framepair.catalog.base import pick_sql, query, r6, table, uniform_sql
from framepair.functions.hashing import hash_uniform
from framepair.functions.names import numeric_order
from framepair.functions.picks import even_pick, is_even_pick, val_count
from framepair.operators import ordered, sampling, split
from framepair.plans.unpaired import split_domains


def _docs(spark, sf, *cols):
    return table(spark, sf, "documents").select("doc_id", *cols)


def _chunk_sql(chunk: int, frac: float, over: str, table_sql: str, keep: str) -> str:
    k = f"greatest(1, round_even({frac}e0 * nch, 0)::BIGINT)"
    return f"""
WITH i AS (SELECT {keep}, row_number() OVER ({over} ORDER BY name) - 1 AS idx, count(*) OVER ({over}) AS n FROM ({table_sql})),
c AS (SELECT *, idx // {chunk} AS chunk_id, greatest(1, (n + {chunk} - 1) // {chunk}) AS nch FROM i)
SELECT {keep}, idx, chunk_id, CASE WHEN {pick_sql("chunk_id", "nch", k)} THEN 'val' ELSE 'train' END AS split FROM c"""


@query("chunk_split", _chunk_sql(17, 0.1, "", "SELECT doc_id, doc_id AS name FROM documents", "doc_id"))
def chunk_split(spark, sf):
    return split.chunk_split(_docs(spark, sf), [], ["doc_id"], 0.1, 17)


@query("domain_split", _chunk_sql(9, 0.25, "PARTITION BY lang", "SELECT doc_id, lang, doc_id AS name FROM documents", "doc_id, lang"))
def domain_split(spark, sf):
    d = _docs(spark, sf, F.col("lang").alias("modality"), F.col("doc_id").alias("name"))
    out = split_domains(d, 0.25, 9).withColumnRenamed("modality", "lang")
    return out.select("doc_id", "lang", "idx", "chunk_id", "split")


_SESSION = """
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
v AS (SELECT source, {held} AS held FROM s)
SELECT d.doc_id, d.source AS session, CASE WHEN held THEN 'val' ELSE 'train' END AS split FROM documents d JOIN v USING (source)"""


@query("session_split_even", _SESSION.format(held=pick_sql("r", "n", "greatest(1, round_even(0.15e0 * n, 0)::BIGINT)")))
def session_split_even(spark, sf):
    return split.session_split(_docs(spark, sf, F.col("source").alias("session")), ["doc_id"], None, 0.15)


@query("session_split_named", _SESSION.format(held="source IN ('src3', 'src11')"))
def session_split_named(spark, sf):
    return split.session_split(_docs(spark, sf, F.col("source").alias("session")), ["doc_id"], ["src3", "src11"])


@query("missing_sessions", """
SELECT w AS session FROM (VALUES ('src3'), ('nowhere'), ('src99')) t(w) WHERE w NOT IN (SELECT source FROM documents)""")
def missing_sessions(spark, sf):
    return split.missing_sessions(_docs(spark, sf, F.col("source").alias("session")), ["src3", "nowhere", "src99"])


@query("even_picks", f"""
WITH i AS (SELECT doc_id, source, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, source, idx FROM i WHERE {pick_sql("idx", "n", "23")}""")
def even_picks(spark, sf):
    return split.even_picks(_docs(spark, sf, "source"), ["source"], ["doc_id"], 23).select("doc_id", "source", "idx")


@query("pick_positions", f"""
WITH p AS (SELECT p_partkey, (p_partkey % 311 + 1)::BIGINT AS n, (p_size % 40)::BIGINT AS k, (p_partkey % 7 + p_size)::BIGINT AS pos FROM part),
q AS (SELECT *, CASE WHEN k <= 1 THEN 0 WHEN k = k - 1 THEN 0 ELSE floor((k // 2) * ((n - 1)::DOUBLE / nullif(k - 1, 0)))::BIGINT END AS middle FROM p)
SELECT p_partkey, n, k, CASE WHEN k <= 1 THEN 0 WHEN k // 2 = k - 1 THEN n - 1 ELSE middle END AS middle, {pick_sql("pos", "n", "k")} AS hit,
  CASE WHEN p_partkey % 2 = 0 THEN greatest(1, round_even(0.15e0 * n, 0)::BIGINT) ELSE 0 END AS held FROM q""")
def pick_positions(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 311 + 1).alias("n"), (F.col("p_size") % 40).cast("bigint").alias("k"),
        (F.col("p_partkey") % 7 + F.col("p_size")).alias("pos"),
    )
    frac = F.when(F.col("p_partkey") % 2 == 0, F.lit(0.15)).otherwise(F.lit(0.0))
    n, k = F.col("n"), F.col("k")
    return p.select(
        "p_partkey", "n", "k", even_pick(F.floor(k / 2), n, k).alias("middle"), is_even_pick(F.col("pos"), n, k).alias("hit"),
        val_count(frac, n).alias("held"),
    )


@query("picked_frame", """
WITH i AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, idx FROM i WHERE idx = least(130, n - 1)""")
def picked_frame(spark, sf):
    return split.pick_index(_docs(spark, sf, "lang"), ["lang"], ["doc_id"], 130).select("doc_id", "lang", "idx")


@query("numeric_order", """
WITH f AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS stem FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END,
  CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id END, stem) - 1 AS idx FROM f""")
def numeric_order_query(spark, sf):
    text = F.col("doc_id").cast("string")
    f = _docs(spark, sf, "lang").withColumn("name", F.concat(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), text)).otherwise(text), F.lit(".png")))
    keys = numeric_order("name")
    f = f.select("*", *[k.alias(f"_o{i}") for i, k in enumerate(keys)])
    return ordered.dense_index(f, ["lang"], [f"_o{i}" for i in range(len(keys))]).select("doc_id", "idx")


@query("training_batches", f"""
WITH u AS (SELECT doc_id, lang, {uniform_sql("doc_id", "3", "7")} AS u FROM documents),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM u)
SELECT doc_id, lang, idx // 8 AS batch_id, idx % 8 < 4 AS shown FROM i WHERE idx // 8 < n // 8""")
def training_batches(spark, sf):
    d = _docs(spark, sf, "lang").withColumn("u", hash_uniform("doc_id", 3, 7))
    b = split.batches(d, ["lang"], ["u", "doc_id"], 8, drop_last=True)
    # The first four of each batch are what a training run displays.
    return b.select("doc_id", "lang", "batch_id", (F.col("idx") % 8 < 4).alias("shown"))


@query("random_sample", f"""
SELECT doc_id, round(u, 9) AS u FROM (SELECT doc_id, {uniform_sql("doc_id", "0")} AS u FROM documents) ORDER BY u, doc_id LIMIT 300""")
def random_sample(spark, sf):
    chosen = sampling.take_random(_docs(spark, sf), "doc_id", 300, 0)
    return chosen.select("doc_id", F.round(hash_uniform("doc_id", 0), 9).alias("u"))


@query("random_sample_per_session", f"""
WITH u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {uniform_sql("doc_id", "5")}, doc_id) AS rn FROM documents)
SELECT doc_id, source FROM u WHERE rn <= 5""")
def random_sample_per_session(spark, sf):
    return sampling.take_random_per(_docs(spark, sf, "source"), ["source"], "doc_id", 5, 5)


@query("first_pairs", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents
  WHERE n_chars > 300) WHERE rn <= 12""")
def first_pairs(spark, sf):
    d = _docs(spark, sf, "source", "n_chars").where("n_chars > 300")
    return ordered.take_first(d, ["source"], ["doc_id"], 12).select("doc_id", "source")


@query("uniform_moments", f"""
WITH u AS (SELECT lang, {uniform_sql("doc_id", "lang", "0")} AS u FROM documents)
SELECT lang, count(*) AS n, round(avg(u), 6) AS mean, round(min(u), 6) AS low, round(max(u), 6) AS high FROM u GROUP BY 1""")
def uniform_moments(spark, sf):
    d = _docs(spark, sf, "lang").withColumn("u", hash_uniform("doc_id", "lang", 0))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("u")).alias("mean"), r6(F.min("u")).alias("low"), r6(F.max("u")).alias("high"))


_NULLS = "SELECT doc_id, n_chars, CASE WHEN doc_id % 3 > 0 THEN source END AS g FROM documents"


@query("null_group_order", f"""WITH d AS ({_NULLS})
SELECT doc_id, g, row_number() OVER w - 1 AS idx, lag(n_chars) OVER w AS before, lead(n_chars) OVER w AS after FROM d WINDOW w AS (PARTITION BY g ORDER BY doc_id)""")
def null_group_order(spark, sf):
    """Rows without a group form one group and keep their places and neighbours."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("g"))
    seg = ordered.number(ordered.segment(d, ["g"], ["doc_id"]), ["g"])
    seg = ordered.following(ordered.previous(seg, ["g"], ["n_chars"]), ["g"], ["n_chars"])
    return seg.select("doc_id", "g", "idx", F.col("prev_n_chars").alias("before"), F.col("next_n_chars").alias("after"))
