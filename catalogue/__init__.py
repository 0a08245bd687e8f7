"""The registered queries: each pairs a Spark callable with its check in SQL."""

from catalogue import (  # noqa: F401
    charts,
    features,
    files,
    hypotheses,
    models,
    outliers,
    profiles,
    samples,
    tables,
)
from catalogue.registry import CHECKS, QUERIES  # noqa: F401
