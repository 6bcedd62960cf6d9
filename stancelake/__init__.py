"""stancelake: DataFrame operators for stance, tone and policy-communication analytics on Spark."""

import importlib

from stancelake import errors
from stancelake.session import build, table

__version__ = "0.3.0"

#: What users import from here, and the modules that it lies in, which are loaded when they are asked for.
EXPORTS = {
    "ListIndex": "operators.vector_index", "Offline": "operators.offline", "Register": "operators.observations", "Tables": "operators.snapshots", "Terms": "functions.matching",
    "as_of": "operators.asof", "archives": "sources.arrivals", "ask_corpus": "operators.speeches", "ask_speaker": "operators.speeches", "assess": "operators.assessment", "chunk": "functions.text",
    "class_metrics": "operators.evaluation", "hash_embedder": "operators.speeches", "index_speeches": "operators.speeches", "ingest": "operators.ingest", "intervals": "operators.resampling",
    "lead_pairs": "operators.series", "lexicon": "functions.text", "movement": "operators.committee", "nearest_each": "operators.retrieval", "pearson": "operators.series", "publish": "operators.ingest",
    "running": "operators.scan", "sampled": "operators.evaluation", "sentences": "functions.text", "standing_series": "operators.series", "tfidf": "operators.features", "validated": "operators.ingest",
}

__all__ = ["build", "errors", "table", *EXPORTS]


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"stancelake.{EXPORTS[name]}"), name)
