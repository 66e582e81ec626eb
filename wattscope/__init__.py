"""Fleet telemetry analytics expressed as Spark DataFrame operators."""

from wattscope.settings import FleetSettings

__all__ = ["FleetSettings"]
