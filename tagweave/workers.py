"""Make Python-worker code independent of where the package is installed.

Functions handed to ``mapInPandas`` / ``applyInPandasWithState`` are pickled
by module reference by default, so every executor would need this package
on its path.  Modules registered here are pickled by value instead: the
function and the module-level helpers it uses travel with the task.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
