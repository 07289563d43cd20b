"""Molecule-sequence corpora on Spark: tokens, vocabulary, corruption, losses, metrics and run analysis.

Every public operator is a function from DataFrame (or Column) to DataFrame (or Column).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
