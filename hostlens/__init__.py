"""hostlens: host and process telemetry analytics on PySpark DataFrames."""

from hostlens.params import Params
from hostlens.session import configure

__all__ = ["Params", "configure"]
