"""Settings, from environment variables or keywords."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: Environment names, defaults and truthy words.
TRUTHY = frozenset({"1", "true", "yes", "on"})


def env_int(env: Mapping[str, str], name: str, default: int) -> int:
    """An integer setting; anything that isn't one falls back."""
    try:
        return int(env[name])
    except (KeyError, ValueError):
        return default


def env_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    raw = env.get(name)
    return default if raw is None else raw.strip().lower() in TRUTHY


def duration_label(seconds: int) -> str:
    """Whole hours as ``2h``, else whole minutes as ``5m``, else seconds; 0 and less is ``0s``."""
    if seconds <= 0:
        return "0s"
    for size, unit in ((3600, "h"), (60, "m")):
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


@dataclass(frozen=True)
class Settings:
    metric_prefix: str = "cdn_"
    unmatched_logging: bool = True
    unmatched_max_tracked: int = 5000
    legacy_stream_name: bool = True
    startup_offset_ms: int = 0
    retry_max_attempts: int = 5
    retry_base_seconds: float = 1.0
    retry_max_seconds: float = 30.0
    unique_window_seconds: int = 3600
    session_window_seconds: int = 7200
    session_gap_seconds: int = 120
    session_state_path: str = ""
    session_state_interval_seconds: int = 300

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.unique_window_seconds <= 0:
            put("unique_window_seconds", 3600)
        # sessions must outlive the window in which they are counted
        put("session_window_seconds", max(self.session_window_seconds, self.unique_window_seconds))
        put("session_gap_seconds", max(1, self.session_gap_seconds))
        put("session_state_interval_seconds", max(5, self.session_state_interval_seconds))

    @property
    def window_label(self) -> str:
        return duration_label(self.unique_window_seconds)

    def metric(self, suffix: str) -> str:
        return self.metric_prefix + suffix

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(
            metric_prefix=env.get("METRIC_PREFIX", cls.metric_prefix),
            unmatched_logging=env_bool(env, "UNMATCHED_DEVICE_LOGGING", cls.unmatched_logging),
            unmatched_max_tracked=env_int(env, "UNMATCHED_DEVICE_MAX_TRACKED", cls.unmatched_max_tracked),
            legacy_stream_name=env_bool(env, "EMIT_LEGACY_STREAM_NAME_LABEL", cls.legacy_stream_name),
            startup_offset_ms=env_int(env, "STARTUP_OFFSET_MS", cls.startup_offset_ms),
            retry_max_attempts=env_int(env, "PROMETHEUS_RETRY_ATTEMPTS", cls.retry_max_attempts),
            retry_base_seconds=float(env.get("PROMETHEUS_RETRY_BASE_DELAY_SECONDS", cls.retry_base_seconds)),
            retry_max_seconds=float(env.get("PROMETHEUS_RETRY_MAX_DELAY_SECONDS", cls.retry_max_seconds)),
            unique_window_seconds=env_int(env, "UNIQUE_VIEWERS_WINDOW_SECONDS", cls.unique_window_seconds),
            session_window_seconds=env_int(env, "SESSION_WINDOW_SECONDS", cls.session_window_seconds),
            session_gap_seconds=env_int(env, "SESSION_GAP_SECONDS", cls.session_gap_seconds),
            session_state_path=env.get("SESSION_STATE_PATH", cls.session_state_path),
            session_state_interval_seconds=env_int(env, "SESSION_STATE_SAVE_INTERVAL_SECONDS", cls.session_state_interval_seconds),
        )
