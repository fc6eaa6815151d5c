"""Training-data operators over landed text tables (documents, conversations).

Each module holds one operator with a general interface; ``queries`` wraps them
as the registered ``opN_<name>`` queries. Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors as code, so a cluster needs
# no copy of the package on its Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
