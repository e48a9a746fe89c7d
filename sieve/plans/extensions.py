"""User functions by name: formatters, recipes and renderers that a configuration
names by a dotted path (``package.module.function``) or by file
(``/path/to/module.py:function``), as a command line would give them.

The module is imported on the driver and, if it comes from a file, shipped to the
executors, so that a function may also use it inside a pandas UDF.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def load_function(spark: SparkSession, name: str) -> Callable:
    """The function a dotted path or ``file.py:function`` names. A name without a
    module, a missing module, a missing function and something that can't be called
    each raise with the name given."""
    if ".py:" in name:
        path, _, function = name.rpartition(":")
        module_name = os.path.splitext(os.path.basename(path))[0]
        if not os.path.isfile(path):
            raise ValueError(f"{name}: no file {path}")
        held = sys.modules.get(module_name)
        if held is not None and os.path.realpath(getattr(held, "__file__", None) or "") != os.path.realpath(path):
            raise ValueError(f"{name}: another module is named {module_name}")
        if held is None:
            spec = importlib.util.spec_from_file_location(module_name, path)
            held = importlib.util.module_from_spec(spec)
            sys.modules[module_name] = held
            try:
                spec.loader.exec_module(held)
            except BaseException:
                del sys.modules[module_name]
                raise
            spark.sparkContext.addPyFile(path)
        module = held
    else:
        module_name, _, function = name.rpartition(".")
        if not module_name:
            raise ValueError(f"{name}: give module.function or file.py:function")
        try:
            module = importlib.import_module(module_name)
        except ModuleNotFoundError as exc:
            if exc.name is None or not (module_name == exc.name or module_name.startswith(f"{exc.name}.")):
                raise                       # something that the module itself imports
            raise ValueError(f"{name}: no module {module_name}") from exc
    found = getattr(module, function, None)
    if not callable(found):
        raise ValueError(f"{name}: {module_name} has no function {function}")
    return found


def load_formatter(spark: SparkSession, name: str) -> Callable[[Column], Column]:
    """A function from Column to Column, tried on a literal column at once, so that
    one that takes text or gives something else fails here and not in a task."""
    formatter = load_function(spark, name)
    try:
        out = formatter(F.lit("text"))
    except Exception as exc:
        raise TypeError(f"{name} does not take a Column: {exc}") from exc
    if not isinstance(out, Column):
        raise TypeError(f"{name} gives {type(out).__name__}, not a Column")
    return formatter
