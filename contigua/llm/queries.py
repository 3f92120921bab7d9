"""The contract's queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, html_text, itq, media, mixing, packing, quality, simhash, token_file, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public word tokenizer's file; a parameter of the operators, looked up where a query runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as token ids in shards, written and read back. Null text is the end id alone; null ids come
    first; repeated rows are written each for itself; an empty table gives no rows; long texts are encoded whole."""
    return token_file.token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document. Null texts have size 0, null sources come last, null and repeated ids share a
    key; an empty table gives no rows; long texts are counted whole."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and wordless texts have fingerprint zero; repeated rows give
    repeated rows; an empty table gives no rows; every shingle of a long text counts."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url. Null and schemeless urls have neither and are allowed; repeated
    rows are judged alike; an empty table gives no rows."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. Null and empty texts have the score of an empty text; repeated rows are scored alike; an
    empty table gives no rows; long texts are compressed whole, block by block."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document. Null text is the end id alone; repeated rows are packed each for itself;
    an empty table gives no rows; only documents beyond the capacity are cut."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document. Null text is the end alone; repeated rows are learned from and scored as often as
    they stand; an empty table gives no rows; the recursion runs over whole texts."""
    return hmm.language_model(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty html give an empty text; repeated rows are extracted alike; an empty table
    gives no rows; long pages are read whole."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null, zero and non-finite vectors and those of other lengths link with nothing;
    equal vectors all count; an empty table gives no rows."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every image whose id is divisible by 20, against all images; and the class of every image."""
    images = media.rendered(table(spark, sf_dir, "embeddings"))
    return media.copies_and_members(media.edits(images.where(F.col("media_id") % 20 == 0)), images)


QUERIES = {f.__name__: f for f in (op1_token_file, op2_source_mix, op3_simhash, op4_url_filter, op5_quality, op6_best_fit_packing, op7_hmm, op8_image_copies, op9_html_text, op10_itq)}
ORACLES: dict[str, str] = {"op2_source_mix": mixing.ORACLE}
