"""Column expressions (JVM side, no Python UDFs except the text labels)."""

from .calendar import calendar_columns, cyclic_columns
from .phases import PHASE_ORDER, OTHER_PHASE, phase
from .binning import VOLUME_LABELS, volume_category
from .numeric import clip_at_zero, log_target, inverse_log

__all__ = [
    "calendar_columns", "cyclic_columns", "PHASE_ORDER", "OTHER_PHASE", "phase",
    "VOLUME_LABELS", "volume_category", "clip_at_zero", "log_target", "inverse_log",
]
