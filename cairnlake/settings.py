"""What a store is set to, from names and texts such as those of a session's configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

SECONDS = {"s": 1, "m": 60, "h": 3600}


def bytes_of(text: str) -> int:
    """``10MB``, ``1 g``, ``512K``, ``7`` as bytes."""
    found = re.fullmatch(r"\s*(\d{1,18})\s*(?:([GMK])B?)?\s*", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) * {"G": 1 << 30, "M": 1 << 20, "K": 1 << 10}.get((found[2] or "").upper(), 1)


def seconds_of(text: str) -> int:
    """``30m``, ``1h``, ``1h30m``, ``45s`` as seconds."""
    parts = re.findall(r"(\d+)([smh])", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a time: {text!r}")
    return sum(int(n) * SECONDS[u] for n, u in parts)


@dataclass(frozen=True)
class Settings:
    """Sizes in bytes, times in seconds."""

    folder: str = "./data"
    volume_size: int = 10 << 30
    upload_size: int = 500 << 20
    compression: str = "auto"
    least_saving: float = 10.0
    expiry_interval: int = 3600
    pending_interval: int = 600
    pending_age: int = 1800

    @classmethod
    def of(cls, given: Mapping[str, str], prefix: str = "spark.cairnlake.") -> Settings:
        """The settings that ``given`` names (``spark.cairnlake.volume_size``), the others as they are by default."""
        read = {"volume_size": bytes_of, "upload_size": bytes_of, "expiry_interval": seconds_of, "pending_interval": seconds_of, "pending_age": seconds_of, "least_saving": float}
        return cls(**{f.name: read.get(f.name, str)(given[prefix + f.name]) for f in fields(cls) if prefix + f.name in given})
