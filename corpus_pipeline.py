"""From raw documents to packed training sequences.

``STAGES`` run in order; each takes ``(spark, docs, sf_dir)`` and works on all that the
one before kept, which is written as Parquet and read again in between. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framepair.llm import decontaminate, minhash, packing, rules, substrings
from framepair.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps."""
    return rules.cascade(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id, by shingles of five words at 0.8.

    A row is known by 128 bits of all its values, so an id may be null or shared. Rows that
    are equal in every value are one row met several times, of which one stays.
    """
    row = [F.lit(0), *[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]]
    prints = [F.xxhash64(*row), F.xxhash64(F.lit(1), *reversed(row))]
    # Fields compare in order: a null id is never the least of a group that has another.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), prints[0].alias("k1"), prints[1].alias("k2"))
    found = minhash.near_duplicates(docs.select(key.alias("row"), "text"), key="row")
    # Rows without shingles (no text) are linked with nothing, not even with one another.
    met = found.where("n_shingles > 0").groupBy("row.k1", "row.k2").agg(F.first("kept").alias("_kept"), F.count(F.lit(1)).alias("_met"))
    marks = materialise(met.where("not _kept or _met > 1").withColumnsRenamed({"k1": "_m1", "k2": "_m2"}), "marks")
    k1, k2 = "_k1", "_k2"
    rows = docs.withColumns({k1: prints[0], k2: prints[1]})
    same = (F.col(k1) == F.col("_m1")) & (F.col(k2) == F.col("_m2"))
    kept = rows.join(marks, same, "left_anti").select(*docs.columns)
    again = marks.where("_kept")
    if not again.isEmpty():
        kept = kept.unionByName(rows.join(again, same, "left_semi").dropDuplicates([k1, k2]).select(*docs.columns))
    return kept


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words or strings of 400 bytes that also start elsewhere; ``n_chars`` follows."""
    kept = substrings.remove_repeats(docs, as_text=True, words=51)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequences they stand in."""
    return packing.pack_texts(docs, *packing.public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

# The stages have no SQL form; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
