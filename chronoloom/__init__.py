"""Multi-series hourly and daily panel analytics, written as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from chronoloom.spec import (
    AIR_QUALITY,
    ArtifactMissingError,
    HorizonUnavailableError,
    PanelSpec,
    PanelValidationError,
)

__all__ = [
    "AIR_QUALITY",
    "ArtifactMissingError",
    "HorizonUnavailableError",
    "PanelSpec",
    "PanelValidationError",
]

# Predictors travel to the executors by value, so no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
