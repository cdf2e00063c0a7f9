"""Training-data pipeline operators.

One module per operator; each has a general function for a caller's own
tables.  ``queries.py`` holds the thin registered queries over the given
tables and ``oracles.py`` their SQL where SQL can express them.  Nothing
outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors
# need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
