"""Summaries and embeddings by a model that is called with texts.

A model is a plain function that executors call: `complete(title, text)` gives a
summary, `request(texts)` gives a vector for each text.  What a client needs is
made by the function itself, so it must be picklable and may import lazily.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import content

Summarizer = Callable[[Column, Column], Column]
Embedder = Callable[[Column], Column]


def extractive(max_chars: int = 1200, max_sentences: int = 6) -> Summarizer:
    return lambda title, text: content.summary(text, max_chars, max_sentences)


def model_summarizer(complete: Callable[[str, str], str | None], max_chars: int = 1200, input_chars: int = 8000) -> Summarizer:
    """Summaries by a model; where it fails the extractive summary stands in."""

    def column(title: Column, text: Column) -> Column:
        @F.pandas_udf("string")
        def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
            def one(name: str | None, body: str | None) -> str:
                body = (body or "").strip()
                if not body:
                    return ""
                try:
                    return (complete(name or "", body[:input_chars]) or "").strip()[:max_chars]
                except Exception:
                    return content.python_summary(body, max_chars)

            return pd.Series([one(n, b) for n, b in zip(titles, texts)], dtype=object)

        return run(T.c(title), T.c(text))

    return column


def model_embedder(request: Callable[[list[str]], list[list[float]]], batch: int = 128, input_chars: int = 8000) -> Embedder:
    """Vectors by a model, which gets up to `batch` texts at a time."""

    def column(text: Column) -> Column:
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            cut = [(t or "")[:input_chars] or " " for t in texts]
            out: list = []
            for at in range(0, len(cut), batch):
                out += [list(map(float, v)) for v in request(cut[at : at + batch])]
            return pd.Series(out, dtype=object)

        return run(T.c(text))

    return column


def openai_request(model: str = "text-embedding-3-small", api_key: str | None = None) -> Callable[[list[str]], list[list[float]]]:
    """A request to OpenAI's embeddings, for `model_embedder`; needs its package on the executors."""

    def request(texts: list[str]) -> list[list[float]]:
        from openai import OpenAI

        answer = (OpenAI(api_key=api_key) if api_key else OpenAI()).embeddings.create(model=model, input=texts)
        return [item.embedding for item in answer.data]

    return request


def openai_complete(model: str = "gpt-4o-mini", api_key: str | None = None) -> Callable[[str, str], str | None]:
    """A summary request to OpenAI's chat, for `model_summarizer`; needs its package on the executors."""

    def complete(title: str, text: str) -> str | None:
        from openai import OpenAI

        client = OpenAI(api_key=api_key) if api_key else OpenAI()
        rules = "Summarize documents for retrieval: short, factual sentences that keep figures, names and dates."
        said = [{"role": "system", "content": rules}, {"role": "user", "content": f"{title}\n\nIn four to six sentences:\n\n{text}"}]
        return client.chat.completions.create(model=model, messages=said, max_tokens=400, temperature=0.2).choices[0].message.content

    return complete
