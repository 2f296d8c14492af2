"""One driver query for each operator of this package, with production settings over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.collocations import collocations
from panelwright.llm.decontamination import contaminated_passages
from panelwright.llm.divergence import source_divergence
from panelwright.llm.exact_dup import exact_duplicates
from panelwright.llm.hilbert import hilbert_shards
from panelwright.llm.html_text import main_text
from panelwright.llm.language_model import score_documents
from panelwright.llm.mixing import mix_sources
from panelwright.llm.near_dup import near_duplicates
from panelwright.llm.packing import packed_rows
from panelwright.llm.quality import judge_quality
from panelwright.llm.secrets import find_secrets
from panelwright.llm.toxicity import toxicity
from panelwright.session import ship_code

#: A public byte-level BPE vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on three-word shingles at a similarity of 0.85."""
    documents = table(spark, sf_dir, "documents")
    return near_duplicates(documents, shingle_words=3, numerator=85, denominator=100)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating, at most three epochs of each."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in all documents."""
    return contaminated_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of token ids."""
    return packed_rows(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal counts along a Hilbert curve."""
    sharded = hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return sharded.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labelled ones that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under an n-gram model of six sevenths of them."""
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents, with the forest's verdicts."""
    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op13_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents; the row with the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of every source differ from those of its language and of its other sources."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of every language."""
    return collocations(table(spark, sf_dir, "documents"))
