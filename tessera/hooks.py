"""Places where models and other services plug in, with deterministic defaults.

A service is called once for each distinct input, in batches, from the executors.
Failures are rows with an error, not failed jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx

BATCH = 64
DIMENSIONS = 384
PREVIEW = 500


class LanguageModel(Protocol):
    name: str

    def complete(self, prompt: str, temperature: float = 0.0) -> str: ...

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.0) -> str: ...


class Echo:
    """A stand-in model: it answers with the first line of what it is asked."""

    name = "echo"

    def complete(self, prompt: str, temperature: float = 0.0) -> str:
        return prompt.split("\n", 1)[0]

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.0) -> str:
        return self.complete(messages[-1]["content"] if messages else "")


PROVIDERS: dict[str, Callable[[], LanguageModel]] = {"echo": Echo}


def provider(name: str = "echo") -> LanguageModel:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name]()


def complete(rows: DataFrame, prompt: str, make: Callable[[], LanguageModel] = Echo, retries: int = 1, out: str = "reply") -> DataFrame:
    """Add ``out`` and ``<out>_error``: the reply to each distinct prompt; after so many retries an empty reply and the error."""
    asked = rows.select(F.col(prompt).alias("__p")).filter("__p is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            found = []
            for p in pdf["__p"]:
                reply, error = "", None
                for _ in range(retries + 1):
                    try:
                        reply, error = model.complete(p), None
                        break
                    except Exception as e:  # noqa: BLE001  any service's failure is a row
                        error = repr(e)
                found.append((p, reply, error))
            yield pd.DataFrame(found, columns=["__p", out, f"{out}_error"])

    replies = asked.mapInPandas(run, f"__p string, {out} string, {out}_error string")
    return rows.join(replies, rows[prompt] == replies["__p"], "left").drop("__p")


def hashed_embedding(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed hashed word counts, of length 1; zero for a blank text."""
    v = np.zeros(dimensions)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, out: str = "embedding") -> DataFrame:
    """Add an embedding. Each distinct text is embedded once, in batches of 64; what fails is a zero vector."""
    distinct = rows.select(F.sha2(text, 256).alias("__k"), F.col(text).alias("__t")).filter("__t is not null").dropDuplicates(["__k"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = embedder or (lambda texts: [hashed_embedding(t) for t in texts])
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                try:
                    vectors = own(part["__t"].tolist())
                except Exception:  # noqa: BLE001
                    vectors = [[0.0] * DIMENSIONS] * len(part)
                yield pd.DataFrame({"__k": part["__k"], out: vectors})

    vectors = distinct.mapInPandas(run, f"__k string, {out} array<double>")
    return rows.withColumn("__k", F.sha2(text, 256)).join(vectors, "__k", "left").drop("__k")


def fields_template(schema: dict[str, str]) -> str:
    """The JSON object that a reply is to look like, each field null."""
    return "{\n" + ",\n".join(f'  "{k}": null' for k in schema) + "\n}"


def names_asked(questions: DataFrame, question: str, make: Callable[[], LanguageModel] | None = None, out: str = "names") -> DataFrame:
    """Add the names that a question is about: from a model's comma list (``NONE``: none), or without one its phrases."""
    if make is None:
        return questions.withColumn(out, tx.phrase_candidates(F.col(question)))
    prompt = F.concat(F.lit("List the names in this question, separated by commas, or NONE.\n"), F.col(question))
    asked = complete(questions.withColumn("__prompt", prompt), "__prompt", make, out="__names")
    names = F.filter(F.transform(F.split("__names", ","), tx.strip), lambda n: n != "")
    none = F.upper(tx.strip(F.col("__names"))).isin("NONE", "")
    return asked.withColumn(out, F.when(none, F.array().cast("array<string>")).otherwise(names)).drop("__prompt", "__names", "__names_error")


def answers(rows: DataFrame, question: str, context: str, make: Callable[[], LanguageModel] | None = None, out: str = "answer") -> DataFrame:
    """Add an answer from the context: a model's, or, without one or where it fails, the context itself."""
    told = F.when(tx.strip(F.coalesce(F.col(context), F.lit(""))) == "", "I couldn't find anything about that.").otherwise(F.col(context))
    if make is None:
        return rows.withColumn(out, told)
    prompt = F.concat(F.lit("Answer from the context alone.\n\nContext:\n"), F.coalesce(F.col(context), F.lit("")), F.lit("\n\nQuestion: "), F.col(question))
    asked = complete(rows.withColumn("__prompt", prompt), "__prompt", make, out="__answer")
    return asked.withColumn(out, F.coalesce(tx.blank_to_null(F.col("__answer")), told)).drop("__prompt", "__answer", "__answer_error")


def fields_prompt(schema: dict[str, str], text: Column) -> Column:
    """A request for the schema's fields in JSON, and the text."""
    fields = "\n".join(f"- {k}: {v}" for k, v in schema.items())
    return F.concat(F.lit(f"Give these fields as one JSON object:\n{fields}\n\nLike this:\n{fields_template(schema)}\n\n"), text)
