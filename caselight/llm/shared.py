"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..session import ensure_checkpoint_dir
from .wordhash import sub_batches

#: Separators of words in most operators.
SEPARATORS = r"[\x20\x09-\x0D]+"


def kept_aside(df: DataFrame) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir``, so that later steps don't redo them.

    The folder is shared by all executors: the rows survive the loss of any of them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def all_columns(df: DataFrame) -> list[Column]:
    return [column(c) for c in df.columns]


def without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` without the columns of these names."""
    gone = {n.lower() for n in names}
    return df.select([column(c) for c in df.columns if c.lower() not in gone])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, each unlike all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _unordered(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType))


def comparable(df: DataFrame, name: str) -> Column:
    """The column, or its JSON text where Spark can't order or hash its type."""
    return F.to_json(F.struct(column(name))) if _unordered(df.schema[name].dataType) else column(name)


def words(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def n_words(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words(text)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, text: str = "text", most: int = 4 << 20) -> DataFrame:
    """``f`` on Arrow batches of ``df`` with about ``most`` bytes of text at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch[text]).fill_null(0).to_pylist()
            for a, b in sub_batches([s + 16 for s in sizes], most):
                out = f(batch.slice(a, b - a))
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
