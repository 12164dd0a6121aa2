"""Tunables of the operators. Times are whole milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

# Statuses that appear in tables.
TERMINAL_STATUSES = ("stopped", "failed", "completed", "timed_out")

# Request and upload limits.
MAX_NAME_CHARS = 80
MAX_REQUEST_ID_CHARS = 128
MAX_BATCH_TARGETS = 20
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_IMAGE_PIXELS = 20_000_000
UPLOAD_TYPES = ("image/jpeg", "image/png", "image/webp")
LIVE_SCHEMES = ("rtsp", "rtsps")

# Event history lengths.
EVENT_HISTORY = 256
LATENCY_WINDOW = 1000
FRAME_QUEUE = 2

DEFAULT_SIMILARITY = 0.55


@dataclass(frozen=True)
class QualityProfile:
    """Gate and scoring limits for one use of a face crop."""

    min_side: int
    min_blur: float
    min_detection: float
    min_brightness: float = 35.0
    max_brightness: float = 225.0
    max_roll: float | None = None
    max_yaw: float | None = None


SEARCH = QualityProfile(min_side=80, min_blur=45.0, min_detection=0.45)
ENROLMENT = QualityProfile(
    min_side=100, min_blur=5.0, min_detection=0.60, max_roll=25.0, max_yaw=0.45
)


@dataclass(frozen=True)
class DetectorParams:
    input_h: int = 416
    input_w: int = 416
    strides: tuple[int, ...] = (8, 16, 32)
    min_score: float = 0.25
    max_iou: float = 0.45


@dataclass(frozen=True)
class TrackerParams:
    high: float = 0.5
    low: float = 0.1
    first_iou: float = 0.3
    second_iou: float = 0.2
    buffer: int = 30


@dataclass(frozen=True)
class EvidenceParams:
    required: int = 3
    window_ms: int = 1500
    separation_ms: int = 200
    throttle_ms: int = 500
    grace_ms: int = 2000

    def __post_init__(self):
        if self.required < 1:
            raise ValueError("required must be at least 1")
        if min(self.window_ms, self.separation_ms, self.throttle_ms, self.grace_ms) < 0:
            raise ValueError("evidence times must not be negative")
        if self.throttle_ms > self.grace_ms:
            raise ValueError("throttle must not exceed grace")

    @property
    def declarative(self) -> bool:
        """True when a loss always outlives window, separation and throttle, so that the
        state machine decomposes into ordered flags, a window count and episodes."""
        return 0 < self.separation_ms <= self.window_ms <= self.grace_ms


@dataclass(frozen=True)
class EvalCriteria:
    min_recall: float = 0.9
    max_false_per_hour: float = 0.1
    min_exposure_hours: float = 10.0


#: Codes of what can be amiss with a list of similarity thresholds.
NO_THRESHOLD, THRESHOLD_RANGE, THRESHOLD_REPEATED = (
    "no_threshold",
    "threshold_out_of_range",
    "threshold_repeated",
)


def check_thresholds(values) -> tuple[float, ...]:
    """The thresholds as floats; a ValueError names the first code and value that does not do.
    They are cosines, and each of them names a row of the results."""
    seen: dict[float, None] = {}
    for value in map(float, values):
        if value in seen:
            raise ValueError(f"{THRESHOLD_REPEATED}: {value}")
        if not abs(value) <= 1.0:
            raise ValueError(f"{THRESHOLD_RANGE}: {value}")
        seen[value] = None
    if seen:
        return tuple(seen)
    raise ValueError(NO_THRESHOLD)
