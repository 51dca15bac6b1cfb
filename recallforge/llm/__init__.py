"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
