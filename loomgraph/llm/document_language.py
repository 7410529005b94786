"""Languages of documents and of the passages in them (problem 10), by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import languages, prose

#: Documents that a worker scores at a time, which bounds its memory.
_ROWS = 500
_SCHEMA = "doc_id bigint, code string, passages array<struct<lang:string,confidence:double,sentences:int,text:string>>"


def fit_profiles(documents: DataFrame, lang_codes: DataFrame, text: str = "text", label: str = "lang") -> languages.Profiles:
    """Profiles from a sample of the labelled documents (bounds: ``languages.SAMPLE_*``); wrong labels are cleaned out.

    Without any labelled sentence there is nothing to learn from: the profiles know no language, and no text has any.
    """
    rows = documents.select(F.col(text).alias("text"), F.col(label).alias("label"))
    texts, labels = languages.sentence_set(languages.sample(rows, languages.canonical(F.col("label"), lang_codes)))
    return languages.Profiles().fit(texts, labels) if texts else languages.Profiles()


def passages(documents: DataFrame, lang_codes: DataFrame, model: languages.Profiles, key: str = "doc_id", text: str = "text", label: str = "lang", texts: bool = True) -> DataFrame:
    """(doc_id, code, passages): the language that the label names, or null, and the passages of each document.

    A passage is a run of sentences in one language, which in lines of code are those of comments and literals, with the mean confidence of its sentences. Null, empty and blank
    texts, and texts without a sentence, have no passages. Whole texts are read; rows are handled one by one, so
    repeated texts and ids stay apart. Other columns are left out. Without ``texts`` the passages' own are null.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # prototypes of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = shared.value
        for pdf in (b.iloc[i : i + _ROWS] for b in batches for i in range(0, len(b), _ROWS)):
            found = [prose.document_sentences(t) if isinstance(t, str) and profiles.languages else [] for t in pdf["text"]]
            flat = [s for x in found for s in x]
            best, sure = languages.settle(profiles.cosines(flat), [len(x) for x in found]) if flat else ([], [])
            named = [(profiles.languages[b], c) for b, c in zip(best, np.asarray(sure).tolist())]
            at, out = 0, []
            for x in found:
                rows = []
                for lang, run in groupby(range(at, at + len(x)), lambda i: named[i][0]):
                    own = list(run)
                    rows.append({"lang": lang, "confidence": sum(named[i][1] for i in own) / len(own), "sentences": len(own), "text": "\n".join(flat[own[0] : own[-1] + 1]) if texts else None})
                at += len(x)
                out.append(rows)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "code": pdf["code"], "passages": out})

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), languages.canonical(F.col(label), lang_codes).alias("code"), F.col(text).alias("text"))
    return rows.mapInPandas(run, _SCHEMA)


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, code, lang, share, confidence): one row for each language of each document, from ``passages``.

    share is of the document's sentences; confidence is the mean over its passages, weighted by sentences.
    A repeated doc_id gives the rows of each of its documents.
    """
    langs = F.array_distinct(F.transform("passages", lambda p: p["lang"]))

    def of(lang):
        own = F.filter("passages", lambda p: p["lang"] == lang)
        n = F.aggregate(own, F.lit(0), lambda a, p: a + p["sentences"])
        return F.struct(lang.alias("lang"), n.alias("n"), F.aggregate(own, F.lit(0.0), lambda a, p: a + p["confidence"] * p["sentences"]).alias("c"))

    total = F.aggregate("passages", F.lit(0), lambda a, p: a + p["sentences"])
    rows = found.select("doc_id", "code", total.alias("total"), F.size(langs).alias("langs"), F.inline(F.transform(langs, of)))
    return rows.select("doc_id", "code", "langs", "lang", (F.col("n") / F.col("total")).alias("share"), (F.col("c") / F.col("n")).alias("confidence"))


def mislabelled(found: DataFrame) -> DataFrame:
    """The rows of ``document_languages`` whose label is missing, names no language of the text, or is too narrow."""
    right = F.exists("passages", lambda p: p["lang"] == F.col("code"))
    narrow = F.size(F.array_distinct(F.transform("passages", lambda p: p["lang"]))) > 1
    return document_languages(found.where(F.col("code").isNull() | ~right | narrow))
