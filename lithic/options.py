"""Options of the engine, all with defaults, and their validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

MIB = 1 << 20


@dataclass(frozen=True)
class Options:
    """Sizes are in bytes. ``chunking`` is ``cdc`` or ``fixed``.

    Features are taken of whole chunks, or of their first ``feature_prefix`` bytes.
    """

    chunking: str = "cdc"
    min_chunk: int = 4096
    avg_chunk: int = 8192
    max_chunk: int = 16384
    rolling_window: int = 48
    segment: tuple[int, int, int] = (1 * MIB, 2 * MIB, 4 * MIB)
    container_group: tuple[int, int, int] = (512 * MIB, 1024 * MIB, 2048 * MIB)
    super_features: int = 4
    feature_prefix: int | None = None
    diff_window: tuple[int, int] = (48, 256)
    container_cap: int = 8 * MIB
    delta_container_cap: int = 8 * MIB
    compact_below: int = 8_300_000
    nul_safe: bool = False

    def __post_init__(self) -> None:
        if self.chunking == "fixed":
            if not self.min_chunk == self.avg_chunk == self.max_chunk > 0:
                raise ValueError("fixed chunking takes one size: min = avg = max > 0")
        elif self.chunking == "cdc":
            if not 0 < self.min_chunk < self.avg_chunk < self.max_chunk:
                raise ValueError("content-defined chunking takes 0 < min < avg < max")
            if self.avg_chunk < 2 or self.rolling_window < 1:
                raise ValueError("avg must be 2 and the rolling window 1 at least")
        else:
            raise ValueError(f"unknown chunking {self.chunking!r}")

    @property
    def mask_bits(self) -> int:
        """floor(log2 avg); the hash has 16 bits, so more have no effect."""
        return min(16, self.avg_chunk.bit_length() - 1)


#: Parameters for single documents, which are far smaller than backup files.
DOCUMENTS = Options(min_chunk=128, avg_chunk=512, max_chunk=2048, segment=(2048, 4096, 8192), container_group=(8192, 16384, 32768))


def from_json(text: str) -> Options:
    """Options from a JSON object; unknown keys are ignored, absent ones take defaults."""
    given = json.loads(text)
    names = {f.name for f in fields(Options)}
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names})
