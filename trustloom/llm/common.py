"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.sources.storage import delete, shared_folder
from trustloom.sources.tables import table

__all__ = ["SPACE", "WORD", "discard", "free_names", "given", "materialise", "put_back", "quoted", "release", "set_aside", "shared_folder", "shared_path", "table", "text_of", "unpacked", "whole_row", "word_count"]

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: The paths that this run (thread or task) has been given; runs beside it have lists of their own.
_RUN: ContextVar[list[str]] = ContextVar("paths")


def _paths() -> list[str]:
    if _RUN.get(None) is None:
        _RUN.set([])
    return _RUN.get()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; :func:`release` deletes what lies there."""
    _paths().append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _paths()[-1]


def given() -> int:
    """How many paths :func:`shared_path` has given in this run and :func:`release` has not deleted."""
    return len(_paths())


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables of this run but for the first ``since`` and the last ``keep``, once what was made of them has been
    written elsewhere."""
    paths = _paths()
    gone = paths[since : len(paths) - keep]
    del paths[since : len(paths) - keep]
    for folder in gone:
        delete(spark, folder)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation of what came
    before) and gives the optimizer the true size of the table, by which it
    decides between a broadcast and a shuffled join.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """A column name for each of ``wanted`` that none of ``taken`` has (in any case of letters)."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column name that may hold dots, as Spark reads it."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that whatever they are called they don't clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str], *more: str | Column) -> DataFrame:
    """The columns ``names`` of a struct made by :func:`whole_row`, and ``more``."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in names], *more)


def set_aside(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and, as one struct ``others``, all other columns, so that an operator's own names can't clash."""
    others = [c for c in df.columns if c not in own]
    return df.select(*own, *([F.struct(*[F.col(quoted(c)).alias(c) for c in others]).alias("others")] if others else []))


def put_back(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns ``columns`` of what :func:`set_aside` gave, in their order."""
    return df.select(*[F.col(c) if c in own else F.col("others").getField(c).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
