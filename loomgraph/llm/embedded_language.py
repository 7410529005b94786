"""Natural language inside code (problem 5): comments, docstrings and literals, their languages and shares."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import languages, prose

_SPANS = "chunk_id bigint, file_path string, kind string, lang string, confidence double, chars int, text string"


def fit_regression(documents: DataFrame, lang_codes: DataFrame) -> languages.Regression:
    """Logistic regression from a sample of labelled documents (bounds: ``languages.SAMPLE_*``); one that knows no language if there are none."""
    texts, labels = languages.sentence_set(languages.sample(documents.select("text", "lang"), languages.canonical(F.col("lang"), lang_codes)))
    return languages.Regression().fit(texts, labels) if texts else languages.Regression()


def language_spans(chunks: DataFrame, model: languages.Regression, size: int = prose.BLOCK) -> DataFrame:
    """(chunk_id, file_path, kind, lang, confidence, chars, text): the sentences in comments, docstrings and literals.

    ``chunks``: chunk_id, file_path, docstring, inline_comments, content; other columns are left out. Every content is lexed in
    blocks of ``size`` characters, whose state-transition functions are composed by parallel prefix (``pylex.pieces``);
    literals that go on over blocks are joined before sentences are cut, so the rows do not depend on ``size``. A text is one
    row, so its blocks are lexed where it is. Each occurrence in the content counts; sentences of docstring and comments count
    beside it only if the content has lost them, each once. Nulls and empty texts give no rows.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the input

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        regression = shared.value
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                inside = [(kind, s) for kind, _, _, found in prose.code_sentences(r.content, size) for s in found] if isinstance(r.content, str) else []
                beside = [("docstring", s) for s in prose.sentences(r.docstring)] if isinstance(r.docstring, str) else []
                if r.inline_comments is not None:
                    beside += [("comment", s) for c in r.inline_comments if c for s in prose.sentences(c)]
                seen = {s for _, s in inside}
                lost = {s: kind for kind, s in reversed(beside) if s not in seen}
                rows += [(r.chunk_id, r.file_path, kind, len(s), s) for kind, s in [*inside, *((kind, s) for s, kind in lost.items())]]
            if not rows or not regression.languages:
                continue
            out = pd.DataFrame(rows, columns=["chunk_id", "file_path", "kind", "chars", "text"])
            distinct = out["text"].drop_duplicates().tolist()
            got = dict(zip(distinct, zip(*regression.predict(distinct))))
            out["lang"] = [got[t][0] for t in out["text"]]
            out["confidence"] = [float(got[t][1]) for t in out["text"]]
            yield out[["chunk_id", "file_path", "kind", "lang", "confidence", "chars", "text"]]

    return chunks.select("chunk_id", "file_path", "docstring", "inline_comments", "content").mapInPandas(label, _SPANS)


def file_languages(spans: DataFrame) -> DataFrame:
    """(file_path, lang, sentences, chars, confidence): per file and language, from ``language_spans``.

    Partial sums go through the shuffle, so a file with a third of all spans costs one row a partition.
    """
    return spans.groupBy("file_path", "lang").agg(F.count("*").alias("sentences"), F.sum("chars").alias("chars"), F.max("confidence").alias("confidence"))


def language_shares(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_languages`` with each language's share of the characters of the file's chunks (content)."""
    sizes = chunks.groupBy("file_path").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("file_chars"))
    return file_languages(spans).join(sizes, "file_path").withColumn("share", F.round(F.when(F.col("file_chars") > 0, F.least(F.lit(1.0), F.col("chars") / F.col("file_chars"))).otherwise(0.0), 6))
