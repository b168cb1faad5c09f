"""Operators for a large training-data pipeline.

Nothing outside this package imports it.  Executors unpickle the Python helpers
by reference where they can import the package; where the repository is on no
import path that workers share, the helpers travel by value.
"""

import os
import sys
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parents[2])


def _workers_can_import() -> bool:
    shared = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    return any(os.path.realpath(p) == os.path.realpath(_ROOT) for p in shared if p)


if not _workers_can_import():
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
