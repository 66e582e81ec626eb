"""Thresholds and intervals shared by the batch and the streaming operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FleetSettings:
    # Irradiance under which an asset is not judged, and the one it is rated at (W/m2).
    min_irradiance_wm2: float = 150.0
    reference_irradiance_wm2: float = 1000.0
    # Output under this share of the expectation is a fault (percent, exclusive).
    underperformance_pct: float = 80.0
    # A fault must last this long, in event time, before it is an alert (inclusive).
    sustain_seconds: int = 3600
    # How long late and repeated events are remembered by the stream.
    watermark: str = "2 minutes"
    # Span of one windowed metric row, and the step between rows.
    window_width: str = "60 seconds"
    window_slide: str = "15 seconds"
    # Real seconds between two readings of one inverter; turns OFFLINE counts into minutes.
    sample_interval_seconds: float = 3.0
    # Age after which a live figure is labelled STALE (seconds, exclusive).
    stale_after_seconds: int = 60
    # An inverter-day is cut into pieces of this many seconds so that one busy
    # inverter is spread over many tasks; results do not depend on it.
    slice_seconds: int = 3600

    def __post_init__(self) -> None:
        if self.reference_irradiance_wm2 <= 0:
            raise ValueError("reference_irradiance_wm2 must be positive")
        if self.min_irradiance_wm2 < 0:
            raise ValueError("min_irradiance_wm2 must not be negative")
        if not 0 < self.underperformance_pct <= 100:
            raise ValueError("underperformance_pct must lie in (0, 100]")
        if self.sustain_seconds < 0:
            raise ValueError("sustain_seconds must not be negative")
        if self.slice_seconds <= 0:
            raise ValueError("slice_seconds must be positive")
