"""Training-data operators: packing, sanitising, decontamination, similarity joins, mixing, language ID.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
