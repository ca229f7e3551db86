"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame with the columns of its
input; the last adds how often each document is taken. ``run`` applies them to
``documents``, writing each stage to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concilia.llm import decontamination, lines, mixing, quality, simhash
from concilia.llm.common import staged, unpacked

#: SQL cannot train the classifier of the first stage.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the counted rules and the trained classifier accept.

    A null or empty text has too few words and goes; repeated rows are judged alike. Columns
    beside the text are passed on whatever their names. An empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=4000)
    return unpacked(quality.assess(docs, model).where("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of lines of 50 words or more that occur earlier; what is left whole without
    words, or was it before, is no document any more if something was removed.

    Null and empty texts have no lines and stay as they are; rows that repeat id and text are
    one occurrence and keep equal texts. An empty table stays empty.
    """
    found = lines.dedup_lines(docs, min_words=50).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    changed = F.col("n_removed") > 0
    fresh = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars")),
    }
    field = lambda c: fresh[c] if c in fresh else F.col("row").getField(c)
    return found.select(*(field(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked fingerprints the document with the smallest id.

    Of rows that share an id one stays; rows without an id stay, since nothing tells them
    from each other.
    """
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2, seed=42)
    gone = staged(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id")
    several = staged(several.join(gone, "doc_id", "left_anti"), "repeated")
    kept = docs.join(gone.unionByName(several), "doc_id", "left_anti")
    once = docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item, up to its budget of edits.

    Null and empty texts contain none and stay; repeated rows fare alike. Empty tables, of
    documents or items, drop nothing.
    """
    found = decontamination.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), error_rate=0.05)
    return unpacked(found.where(F.size("matches") == 0), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``size`` (words) and ``copies``: how often the mix takes the document.

    A null text has size 0, a null source is a source of its own, repeated rows get equal
    copies. Where the table has columns of these names (in any case), the added ones are
    ``mix_size`` and ``mix_copies``, with as many more ``mix_`` as it takes. An empty table
    stays empty.
    """
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)
    taken, prefix = {c.lower() for c in docs.columns}, ""
    while taken & {f"{prefix}size", f"{prefix}copies"}:
        prefix += "mix_"
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return mixed.select(*own, F.col("size").alias(f"{prefix}size"), F.col("copies").alias(f"{prefix}copies"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number}")
    return docs
