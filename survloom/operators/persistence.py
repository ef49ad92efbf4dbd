"""Stages with settings as Params and models whose state is a table, saved like other ``pyspark.ml`` stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from typing import Any

from pyspark.ml import Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame


def setting(name: str, doc: str, kind: Callable[[Any], Any] | None = None) -> Param:
    """A Param for the body of a :class:`Configured` class."""
    return Param(Params._dummy(), name, doc, kind)


class Configured(Params, DefaultParamsWritable, DefaultParamsReadable):
    """A stage whose settings are Params of plain values (numbers, texts, lists, dicts).

    It is saved and loaded alone or in a ``Pipeline``, and ``copy({stage.prefix: "x_"})``
    or a parameter grid changes a setting. Subclasses can be made without arguments, as
    loading does.
    """

    def _configure(self, **settings: Any) -> None:
        """Set what is given; None is kept as the default."""
        self._setDefault(**{k: v for k, v in settings.items() if v is None})
        self._set(**{k: v for k, v in settings.items() if v is not None})

    def value(self, name: str) -> Any:
        return self.getOrDefault(name)


class _TableWriter(MLWriter):
    def __init__(self, model: TableModel):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        model = self._model
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(
            model, path, spark, extraMetadata={"options": model.options}
        )
        model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls: type[TableModel]):
        super().__init__()
        self._cls = cls

    def load(self, path: str) -> TableModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self._cls(metadata["options"], spark.read.parquet(f"{path}/table"))
        model._resetUid(metadata["uid"])
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A fitted model: plain options and one table, which may be large.

    Options go to the stage's metadata, the table to Parquet beside it, so the
    model is saved and loaded alone or inside a ``PipelineModel``.
    """

    def __init__(self, options: Mapping, table: DataFrame):
        super().__init__()
        self.options = dict(options)
        self.table = table

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)
