"""Spark ML stages around the fit/transform transformers, so they compose with
``VectorAssembler`` and classifiers in one ``pyspark.ml.Pipeline`` and persist with
``PipelineModel.write().overwrite().save(path)`` / ``PipelineModel.load(path)``."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from sparkfeat.operators.transforms import _KINDS, Transformer


class FeatureStage(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator wrapping an unfitted ``Imputer`` / ``Encoder`` / ``Scaler`` configuration."""

    spec = Param(Params._dummy(), "spec", "JSON {kind, config} of the transformer",
                 typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, spec: str | None = None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    @staticmethod
    def of(transformer: Transformer) -> FeatureStage:
        return FeatureStage(spec=json.dumps({"kind": transformer.kind, "config": transformer.config()}))

    def _fit(self, df: DataFrame) -> FittedFeatureStage:
        doc = json.loads(self.getOrDefault(self.spec))
        t = _KINDS[doc["kind"]].from_config(doc["config"]).fit(df)
        return FittedFeatureStage(state=t.to_json())


class FittedFeatureStage(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Model holding the fitted parameters as JSON; ``transform`` is the projection."""

    state = Param(Params._dummy(), "state", "JSON of the fitted transformer",
                  typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, state: str | None = None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def fitted(self) -> Transformer:
        return Transformer.from_json(self.getOrDefault(self.state))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted().transform(df)
