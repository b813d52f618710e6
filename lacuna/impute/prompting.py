"""Imputation by asking a model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.eval.metrics import DEFAULT_CONFIDENCE_MAP, confidence_label_to_probability
from lacuna.impute.clients import Client
from lacuna.impute.common import entity_type, prediction_columns
from lacuna.kb.knowledge_base import KEY


def confidence_to_prob(
    value: Column, label: Column, mapping: Mapping[str, float] = DEFAULT_CONFIDENCE_MAP
) -> Column:
    """Probability that the cell is 1, from an answer and the confidence in it."""
    p = confidence_label_to_probability(label, mapping)
    return F.when(value == 1, p).when(value == 0, 1 - p)


def parse_reply(reply: Column) -> Column:
    """The first JSON object in the reply; NULL fields if there is none."""
    return F.from_json(
        F.regexp_extract(reply, r"\{[^{}]*\}", 0), "value INT, confidence STRING"
    )


@dataclass(frozen=True)
class PromptingImputer:
    """Sends prompts (entity_id, feature, prompt) to a client, batch by batch.

    The client comes to every task anew. A reply that cannot be read
    gives a prediction with NULL score and pred, so it stays visible.
    """

    client: Client
    mapping: Mapping[str, float] | None = None
    name: str = "prompting"
    batch_size: int = 256

    def replies(self, prompts: DataFrame) -> DataFrame:
        client, size = self.client, self.batch_size

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), size):
                    part = pdf.iloc[start : start + size]
                    yield part[KEY].assign(reply=client.complete(part["prompt"].tolist()))

        return prompts.select(*KEY, "prompt").mapInPandas(
            ask, f"entity_id {entity_type(prompts)}, feature string, reply string"
        )

    def impute(self, prompts: DataFrame) -> DataFrame:
        mapping = DEFAULT_CONFIDENCE_MAP if self.mapping is None else self.mapping
        answered = self.replies(prompts).withColumn("answer", parse_reply(F.col("reply")))
        value, label = F.col("answer.value"), F.col("answer.confidence")
        return answered.select(
            *prediction_columns(self.name, confidence_to_prob(value, label, mapping), label)
        )
