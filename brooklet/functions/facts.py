"""What Python finds in texts, an Arrow batch at a time: entities, points of importance, sentences of a conversation.

Ten to twenty patterns a text: Python's matcher takes a tenth of the time of the same patterns as expressions in the JVM, whose
results go through interpreted lambdas. Calls on the same column are one call in the plan.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from . import entities, extraction, importance


def _lists(rows: list[list[tuple]], names: Iterable[str], kinds: Iterable[pa.DataType]) -> pa.ListArray:
    """Rows of tuples as lists of structs."""
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32()), pa.StructArray.from_arrays(columns, list(names)))


def _facts(texts: pa.Array) -> pa.Array:
    rows = [t or "" for t in texts.to_pylist()]
    found = _lists([entities.found(t) for t in rows], ("name", "type"), (pa.string(), pa.string()))
    points = [importance.points(t) for t in rows]
    return pa.StructArray.from_arrays([found, *(pa.array([p[k] for p in points], pa.float64()) for k in (0, 1))], ["entities", "structure", "action"])


def _extractions(texts: pa.Array) -> pa.Array:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    return _lists([extraction.found(t or "") for t in texts.to_pylist()], ("pattern", "match", "text", "type", "tier"), kinds)


def _struct(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_FACTS = arrow_udf(_facts, _struct(entities=ArrayType(_struct(name=StringType(), type=StringType())), structure=DoubleType(), action=DoubleType()))
_EXTRACTIONS = arrow_udf(_extractions, ArrayType(_struct(pattern=IntegerType(), match=IntegerType(), text=StringType(), type=StringType(), tier=StringType())))


def facts(text: Column) -> Column:
    """struct<entities, structure, action>."""
    return _FACTS(text)


def extractions(text: Column) -> Column:
    """array<struct<pattern, match, text, type, tier>> in the order of PATTERNS and of the text; of a null text empty."""
    return _EXTRACTIONS(text)
