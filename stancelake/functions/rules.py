"""What makes a speaker, a speech and a tone observation valid: a named expression for each rule, for ingest.validated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TONES = ("hawkish", "dovish", "neutral", "mixed")


def length(column: str, least: int, most: int | None = None) -> Column:
    """Code points of a text, both bounds included."""
    n = F.char_length(F.col(column))
    return (n >= least) if most is None else n.between(least, most)


def score(column: str) -> Column:
    """A number in [-1, 1]; NaN is not one."""
    return F.col(column).between(-1.0, 1.0) & ~F.isnan(F.col(column).cast("double"))


def sha256_hex(column: str) -> Column:
    """64 lower-case hexadecimal digits."""
    return F.col(column).rlike(r"\A[0-9a-f]{64}\z")


def one_of(column: str, names: Iterable[str]) -> Column:
    return F.col(column).isin(*names)


def with_zone(column: str) -> Column:
    """A moment as text that names its zone, as Z or an offset, and is one that there is."""
    return F.col(column).rlike(r"(Z|[+-]\d\d:?\d\d)\z") & F.try_to_timestamp(F.col(column)).isNotNull()


def there(*columns: str) -> dict[str, Column]:
    return {column: F.col(column).isNotNull() for column in columns}


def speaker(banks: Iterable[str]) -> dict[str, Column]:
    """Rules of id, name, central_bank, role."""
    return there("id") | {"name": length("name", 1, 200), "central_bank": one_of("central_bank", banks), "role": length("role", 1, 200)}


def observation(moment: Column | None = None) -> dict[str, Column]:
    """Rules of id, speaker_id, observed_at, tone, score, source_sha256, lexicon_score, needs_review.

    A Spark timestamp is a moment in time by itself; `moment` is the rule for one that comes as text.
    """
    return there("id", "speaker_id", "needs_review") | {
        "observed_at": F.col("observed_at").isNotNull() if moment is None else moment,
        "tone": one_of("tone", TONES),
        "score": score("score"),
        "source_sha256": sha256_hex("source_sha256"),
        "lexicon_score": score("lexicon_score"),
    }


def speech(banks: Iterable[str], moment: Column | None = None) -> dict[str, Column]:
    """Rules of a speech with its tone: those of an observation, and the lengths of its texts."""
    bounds = {"title": (1, 500), "url": (1, 2000), "language": (2, 12), "text": (1, None), "summary": (1, 4000), "rationale": (1, 2000), "model_id": (1, 100)}
    mine = {name: rule for name, rule in observation().items() if name != "observed_at"}
    return mine | {"central_bank": one_of("central_bank", banks), "delivered_at": F.col("delivered_at").isNotNull() if moment is None else moment} | {name: length(name, *b) for name, b in bounds.items()}
