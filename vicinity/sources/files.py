"""Files opened where they lie, on driver or executors."""
from __future__ import annotations

import sys

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_file(path: str):
    """A file that can be read at any place, by its local path or a URI that pyarrow knows."""
    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(at)
