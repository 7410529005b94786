"""The queries on training data and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import document_language, embedded_language, function_docs, invalid_files, mixing, neighbors, secrets, splitting, tokens
from loomgraph.storage import checkpointed, current_rows, table


def _chunks(spark: SparkSession, sf_dir: str, *columns: str, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "chunks").where(where).select("chunk_id", *columns, "ingest_seq")
    return current_rows(rows, "chunk_id", "ingest_seq").drop("ingest_seq")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chunk_type belongs to a node, so all rows of a chunk have the same.
    return _chunks(spark, sf_dir, "node_id", "name", "docstring", "content", where="chunk_type = 'function'")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.documented(_functions(spark, sf_dir)).select("chunk_id")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their description and code."""
    return function_docs.pairs(_functions(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "ingest_seq", "vector")
    # A row without a usable vector still outdates older ones, so rows are made current before they are judged.
    current = current_rows(rows, "chunk_id", "ingest_seq").select(F.col("chunk_id").alias("id"), "vector")
    return neighbors.nearest(neighbors.usable(current, 128), 128)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs(_nearest(spark, sf_dir))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's nearest others, with similarity."""
    return _nearest(spark, sf_dir).select(F.col("a").alias("chunk_id"), F.col("b").alias("other_id"), "similarity")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_chunks(spark, sf_dir, "chunk_type", "content", "start_line"), table(spark, sf_dir, "chunk_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece = 0").select("chunk_id", "hard")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return _pieces(spark, sf_dir)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = embedded_language.fit_regression(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))
    return embedded_language.language_spans(_chunks(spark, sf_dir, "file_path", "docstring", "inline_comments", "content"), model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedded_language.file_languages(_spans(spark, sf_dir))
    return found.where("lang <> 'zxx' and file_path is not null").select("file_path", "lang")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each file with sentences, characters and share."""
    sizes = _chunks(spark, sf_dir, "file_path", "content")
    return embedded_language.language_shares(_spans(spark, sf_dir), sizes)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").select("repo", "file_path", "content", "commit_seq")
    return invalid_files.checked_files(current_rows(rows, "file_path", "commit_seq"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("fault <> ''").select("file_path")


def p6_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invalid files with what is wrong with them."""
    return _checked(spark, sf_dir).where("fault <> ''")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files per repository and language."""
    return invalid_files.fault_rates(_checked(spark, sf_dir))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.credentials(_chunks(spark, sf_dir, "repo", "content"), table(spark, sf_dir, "env_vars"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _credentials(spark, sf_dir).select("holder", "holder_id", "line_no").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that held credentials, redacted."""
    return _credentials(spark, sf_dir).groupBy("holder", "holder_id").agg(F.first("redacted").alias("text"), F.count("*").alias("credentials"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf_dir, "documents").withColumn("key", F.struct("doc_id", "source"))
    sized = checkpointed(tokens.count_tokens(documents, key="key").select("key.doc_id", "key.source", "tokens"), costly=True)
    return mixing.mix(sized, table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in the order of its schedule: one row for each use of a document."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, sf_dir)[1]


def _passages(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    documents, codes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")
    return document_language.passages(documents, codes, document_language.fit_profiles(documents, codes), texts=texts)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_language.mislabelled(_passages(spark, sf_dir)).select("doc_id", "lang").distinct()


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every document, with share and confidence."""
    return document_language.document_languages(_passages(spark, sf_dir))


def p10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document, with its language and confidence."""
    return _passages(spark, sf_dir, True).select("doc_id", F.posexplode("passages").alias("passage", "p")).select("doc_id", "passage", "p.lang", "p.confidence", "p.sentences", "p.text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pairs, p2_found, p2_nearest, p4_found, p4_pieces, p5_found, p5_shares, p6_found, p6_faults, p6_rates, p7_found, p7_redacted, p8_ids, p8_counts, p9_mixture, p9_shares, p10_found, p10_languages, p10_passages)
}

SQL: dict[str, str] = {
    "p4_found": r"""
WITH current AS (SELECT chunk_id, chunk_type, content FROM chunks WHERE chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC) = 1)
SELECT chunk_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: length(x))) > max_chars THEN 1 ELSE 0 END AS hard
FROM current JOIN chunk_limits USING (chunk_type) WHERE length(content) > max_chars""",
}
