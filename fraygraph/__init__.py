"""fraygraph: how a directed weighted network loses its routes, as PySpark DataFrames.

Graphs, removal scenarios, runs and curves are DataFrames. Every operator carries a
``scenario`` key, so many knock-outs, trials or randomized graphs advance in one job.
"""

import sys

from pyspark import cloudpickle

# Functions that run on workers travel with their task, so the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
