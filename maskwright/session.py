"""Session defaults and typed settings."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession


def build_session(app: str = "maskwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything in ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Settings:
    """Limits and modes of a run, each validated."""

    enabled: bool = True
    mode: str = "pool"
    style: str = "stealth"
    redact_comments: bool = True
    redact_strings: bool = True
    max_entries: int = 10_000
    idle_ttl_ms: int = 1_800_000
    request_bytes: int = 10 << 20
    response_bytes: int = 10 << 20
    stream_bytes: int = 50 << 20
    max_lines: int = 5_000
    holdback: int = 24

    def __post_init__(self):
        if self.mode not in ("pool", "coherent"):
            raise ValueError(f"mode must be pool or coherent, not {self.mode!r}")
        if self.style not in ("compact", "stealth"):
            raise ValueError(f"style must be compact or stealth, not {self.style!r}")
        for name in ("max_entries", "idle_ttl_ms", "request_bytes", "response_bytes", "stream_bytes", "max_lines", "holdback"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a positive integer")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "MASKWRIGHT_") -> Settings:
        """Settings from ``<prefix><NAME>`` variables; anything that isn't of the setting's type is an error."""
        env = dict(os.environ if env is None else env)
        found = {}
        for name, default in cls().__dict__.items():
            raw = env.get(prefix + name.upper())
            if raw is None or raw == "":
                continue
            if isinstance(default, bool):
                if raw.lower() not in ("true", "false", "1", "0"):
                    raise ValueError(f"{prefix}{name.upper()} must be true or false")
                found[name] = raw.lower() in ("true", "1")
            elif isinstance(default, int):
                if not raw.isdigit():
                    raise ValueError(f"{prefix}{name.upper()} must be a positive integer")
                found[name] = int(raw)
            else:
                found[name] = raw
        return cls(**found)
