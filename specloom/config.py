"""Settings from environment variables; an empty variable counts as unset."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    root: str = "."
    check_interval_hours: float = 24.0
    request_delay_seconds: float = 2.0
    max_file_mb: int = 40
    user_agent: str = "specloom/0.1"

    @property
    def max_file_bytes(self) -> int:
        return self.max_file_mb << 20

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        """The interval is an hour at least, the delay a second at least."""
        get = lambda name, default: (env if env is not None else os.environ).get(name) or default
        return cls(
            root=get("REPO_DIR", cls.root),
            check_interval_hours=max(1.0, float(get("CHECK_INTERVAL_HOURS", cls.check_interval_hours))),
            request_delay_seconds=max(1.0, float(get("REQUEST_DELAY_SECONDS", cls.request_delay_seconds))),
            max_file_mb=int(get("MAX_FILE_MB", cls.max_file_mb)),
            user_agent=get("USER_AGENT", cls.user_agent),
        )
