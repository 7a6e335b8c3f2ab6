"""loomdex: corpus indexing, nearest-chunk retrieval and context packing on Spark.

Every operator is a function from DataFrames to DataFrames; ``plans`` strings
them together into the ``Indexer`` and ``Searcher`` a user calls.
"""

import importlib
import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CellIndex", "Indexer", "LexicalIndex", "Searcher", "build_session", "watch_project"]
__version__ = "0.1.0"

MODULES = {
    "CellIndex": "loomdex.plans.cells",
    "Indexer": "loomdex.plans.indexer",
    "LexicalIndex": "loomdex.plans.lexicon",
    "Searcher": "loomdex.plans.searcher",
    "build_session": "loomdex.session",
    "watch_project": "loomdex.streaming.jobs",
}


def __getattr__(name):
    if name not in MODULES:
        raise AttributeError(name)
    return getattr(importlib.import_module(MODULES[name]), name)
