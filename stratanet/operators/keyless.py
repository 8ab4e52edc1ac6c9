"""Operators over one graph without a key, by way of a constant one."""

from __future__ import annotations

import dataclasses
import functools
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "_graph"


def keyless(fn):
    """Lets ``keys=()`` or ``Roles(())`` stand for a single graph.

    The tables get a constant key, which joins and groups as any other does, and
    it is taken off the result.
    """
    signature = inspect.signature(fn)

    @functools.wraps(fn)
    def call(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        given = bound.arguments
        roles = given.get("roles")
        if "keys" in given and not given["keys"]:
            given["keys"] = (KEY,)
        elif roles is not None and not roles.keys:
            given["roles"] = dataclasses.replace(roles, keys=(KEY,))
        else:
            return fn(*bound.args, **bound.kwargs)
        for name, value in given.items():
            if isinstance(value, DataFrame):
                given[name] = value.withColumn(KEY, F.lit(0))
        out = fn(*bound.args, **bound.kwargs)
        return out.drop(KEY) if isinstance(out, DataFrame) else out

    return call
