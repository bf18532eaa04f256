"""Row functions as Arrow-batched functions of columns, built when first used (types need a session)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Rows of a batch that are Python objects at a time.
PART = 64


def mapped(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """Turn f(value, ...) -> value into a function of columns with the given result type."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list = []

        def call(*columns) -> Column:
            if not made:
                kind = _parse_datatype_string(ddl)
                arrow = to_arrow_type(kind)

                def run(*arrays: pa.Array) -> pa.Array:
                    # Python objects take many times the space of Arrow's: only a part of a batch becomes such at a time
                    parts = (zip(*(a.slice(i, PART).to_pylist() for a in arrays)) for i in range(0, len(arrays[0]), PART))
                    return pa.concat_arrays([pa.array([], arrow), *(pa.array([f(*row) for row in rows], arrow) for rows in parts)])

                # the number of arguments and their kind are read from the signature
                def one(a: pa.Array) -> pa.Array:
                    return run(a)

                def two(a: pa.Array, b: pa.Array) -> pa.Array:
                    return run(a, b)

                def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                    return run(a, b, c)

                made.append(arrow_udf((one, two, three)[len(columns) - 1], kind))
            return made[0](*columns)

        call.row = f
        call.__name__ = getattr(f, "__name__", "mapped")
        call.__doc__ = f.__doc__
        return call

    return wrap
