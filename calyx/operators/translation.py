"""Translation through a glossary, a cache and an injected client.

Only distinct texts that neither the glossary nor the cache knows reach the client,
partition by partition; terms of the glossary are kept by tokens around the call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[str]], list[str]]


def upper_client() -> Client:
    """A client for tests: no service, only upper case."""
    return lambda texts: [t.upper() for t in texts]


def _protected(text: str, terms: Sequence[tuple[str, str]]) -> tuple[str, dict[str, str]]:
    tokens = {}
    for n, (term, target) in enumerate(sorted(terms, key=lambda t: -len(t[0]))):
        if term in text:
            token = f"\ue000{n}\ue001"
            text, tokens[token] = text.replace(term, token), target
    return text, tokens


def translated(rows: DataFrame, text: str, glossary: DataFrame, cache: DataFrame, make_client: Callable[[], Client], terms: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``rows`` with ``translation`` and its ``origin``: glossary, cache, client, or none for null texts.

    ``glossary(src, dst)`` and ``cache(key, value)`` hold each text once.
    """
    known = rows.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    known = known.join(glossary, F.col("_t") == F.col("src"), "left").join(cache, F.col("_t") == F.col("key"), "left")
    hits = known.where("dst is not null or value is not null").select("_t", F.coalesce("dst", "value").alias("translation"), F.when(F.col("dst").isNotNull(), "glossary").otherwise("cache").alias("origin"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            pairs = [_protected(t, terms) for t in batch["_t"]]
            answers = client([p for p, _ in pairs])
            out = []
            for answer, (_, tokens) in zip(answers, pairs):
                for token, target in tokens.items():
                    answer = answer.replace(token, target)
                out.append(answer)
            yield pd.DataFrame({"_t": batch["_t"], "translation": out, "origin": "client"})

    missed = known.where("dst is null and value is null").select("_t").mapInPandas(call, "_t string, translation string, origin string")
    found = hits.unionByName(missed)
    return rows.join(found, F.col(text) == F.col("_t"), "left").drop("_t").withColumn("origin", F.coalesce("origin", F.lit("none")))
