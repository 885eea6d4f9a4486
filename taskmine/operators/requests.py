"""Requests to a language model and their answers, told apart by the digest of the prompt.

A request whose prompt changed has a new key, so an answer to the older wording (or to an older
state of a pull request) is not taken for it, and a prompt that several rows share is asked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = "prompt_key"


def keyed(requests: DataFrame) -> DataFrame:
    """Requests with the digest of their ``prompt``."""
    return requests.withColumn(KEY, F.sha2("prompt", 256))


def _one_each(answers: DataFrame) -> DataFrame:
    """One answer for each key; of several the smallest text, a missing text only where there is no other."""
    return answers.groupBy(KEY).agg(F.min("response").alias("response"))


def to_ask(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts without an answer, each once: key and prompt."""
    return requests.select(KEY, "prompt").join(answers.select(KEY), KEY, "left_anti").groupBy(KEY).agg(F.min("prompt").alias("prompt"))


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows that were answered, with their ``response`` in place of the prompt; a null answer is one."""
    return requests.drop("prompt").join(_one_each(answers), KEY).drop(KEY)
