"""Settings of the engine with environment fallbacks; a malformed value is an error."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

UNITS = {"": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "kb": 10**3, "mb": 10**6, "gb": 10**9}

LEVELS = ("debug", "info", "warn", "error")


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+)([kmg]i?b)?\s*", text.lower())
    if not m:
        raise ValueError(f"invalid size {text!r}")
    return int(m[1]) * UNITS[m[2] or ""]


def parse_flag(text: str) -> bool:
    if (low := text.strip().lower()) not in ("1", "t", "true", "0", "f", "false"):
        raise ValueError(f"invalid flag {text!r}")
    return low in ("1", "t", "true")


@dataclass(frozen=True)
class EngineConfig:
    """``evict`` switches the wheel, ``encrypt`` the encryption of values, ``persist`` the write-ahead log in ``data_dir``."""

    shards: int = os.cpu_count() or 1
    evict: bool = True
    evict_interval_ms: int = 1000
    wheel_slots: int = 256
    max_message_bytes: int = 16 << 20
    max_mem_bytes: int = 0
    encrypt: bool = False
    encryption_key: str = ""
    persist: bool = False
    data_dir: str = "data"
    log_level: str = "info"

    def __post_init__(self) -> None:
        if self.shards < 1:
            raise ValueError("at least one shard")
        if self.encrypt and not self.encryption_key:
            raise ValueError("encryption needs a key")
        if self.encryption_key and len(self.encryption_key.encode()) != 32:
            raise ValueError("the encryption key must have 32 bytes")
        if self.log_level.lower() not in LEVELS:
            raise ValueError(f"unknown log level {self.log_level!r}")

    @classmethod
    def load(cls, given: dict | None = None, env: dict | None = None, prefix: str = "LOOMKV_") -> EngineConfig:
        """Given values over the environment over defaults."""
        env, out = os.environ if env is None else env, {}
        if unknown := set(given or {}) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        for f in fields(cls):
            raw = (given or {}).get(f.name, env.get(prefix + f.name.upper()))
            if raw is not None:
                out[f.name] = raw if not isinstance(raw, str) or f.type == "str" else parse_flag(raw) if f.type == "bool" else parse_size(raw) if "bytes" in f.name else int(raw)
        return cls(**out)
