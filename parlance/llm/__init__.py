"""Training-data operators: fingerprints, toxicity, language-model scoring,
near-duplicate removal, packing, mixing, token files and sharding.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when it is present.
"""

import os
import sys

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _workers_can_import() -> bool:
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    return any(p and os.path.abspath(p) == _ROOT for p in paths)


if not _workers_can_import():
    # The package is on the driver's path only: ship its functions by value.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
