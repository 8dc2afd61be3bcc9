"""Operators for preparing language-model training data, as Spark jobs.

One module per operator; ``queries`` registers one query per operator and
``corpus_pipeline`` (repository top) chains five of them.  Nothing else in the
library imports this subpackage.

Python functions of this subpackage travel to the executors by value, so that
workers need no copy of the repository on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
