"""Operators that large training-data pipelines need, each beside the query that applies it to a whole table.

Nothing else in the library imports this package. Functions that run in Python workers are shipped by
value, so executors need numpy, pyarrow and the codecs an operator names, but not this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from creatorlake.llm import queries  # noqa: E402, F401
from creatorlake.llm.registry import ORACLES, QUERIES  # noqa: E402, F401
