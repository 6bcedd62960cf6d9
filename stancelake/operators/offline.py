"""Everything that a language model does for the library, done without one: one object, the reproducible default."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame

from stancelake.functions import text
from stancelake.operators import assessment, speeches


class Model(Protocol):
    """What is asked of a model, as expressions and functions of tables; a remote one wraps calls in functions of its own."""

    name: str

    def embed(self, texts: Column) -> Column:
        """array<string> -> array<array<float>>, one vector for each text."""

    def verdicts(self, sentences: Column) -> Column:
        """array<string> -> array<struct<label, score>>, one verdict for each sentence."""

    def tones(self, rows: DataFrame) -> DataFrame:
        """Tone, score and rationale of each text."""

    def summaries(self, rows: DataFrame) -> DataFrame:
        """A summary of each text."""

    def answer(self, found: DataFrame, question: str, nothing: str) -> DataFrame:
        """An answer from the chunks that were found."""


@dataclass(frozen=True)
class Offline:
    """Hashed embeddings, verdicts by terms or by a trained classifier, extractive summaries and answers. The same everywhere."""

    name: str = "offline"
    dim: int = 768
    digest: str = "blake2b"
    scorer: Callable[[Column], Column] | None = None
    hawkish: Sequence[str] = text.HAWKISH_TERMS
    dovish: Sequence[str] = text.DOVISH_TERMS

    def embed(self, texts: Column) -> Column:
        return speeches.hash_embedder(self.dim, self.digest)(texts)

    def verdicts(self, sentences: Column) -> Column:
        return (self.scorer or assessment.by_terms(self.hawkish, self.dovish))(sentences)

    def tones(self, rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        return assessment.offline_tone(rows, self.verdicts, key=key, text_col=text_col)

    def summaries(self, rows: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
        return assessment.offline_summary(rows, self.verdicts, key=key, text_col=text_col)

    def answer(self, found: DataFrame, question: str, nothing: str = speeches.NOTHING_OF_ANY) -> DataFrame:
        return speeches.answer_of(found, question, self.embed, nothing)
