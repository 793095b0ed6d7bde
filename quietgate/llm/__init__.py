"""Operators that prepare text for language-model training.

Nothing outside this package imports it; its queries are in ``queries``.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: ship its helpers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
