"""Operators for training-data pipelines. Nothing else in the library imports this package; its queries are in
:mod:`pagemill.llm.queries`."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks carry their code; executors need no copy of the package
