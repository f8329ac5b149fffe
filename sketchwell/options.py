"""Options of the sketches: frozen, validated on construction."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Ranges and defaults that callers rely on. Fixed values.
MAX_CAPACITY = 1 << 30
MAX_ERROR = 0.25
MAX_EXPANSION = 32768
CELL_MAX = (1 << 32) - 1
MAX_INCREMENT = 100_000
BLOOM_DEFAULTS = {"error_rate": 0.01, "capacity": 100, "expansion": 2}
CUCKOO_DEFAULTS = {"capacity": 1024, "bucket_size": 2, "max_iterations": 20, "expansion": 1, "max_expansions": 32}
TOPK_DEFAULTS = {"width": 8, "depth": 7, "decay": 0.9}
COMPRESSION = 100


def _whole(name: str, value, lo: int, hi: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not lo <= value <= hi:
        raise ValueError(f"{name} must be a whole number from {lo} to {hi}, not {value!r}")
    return value


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length() if n > 0 else 0


@dataclass(frozen=True)
class BloomOptions:
    """error_rate in (0, 1), capped at 0.25; expansion 0 means the filter doesn't scale."""

    error_rate: float = BLOOM_DEFAULTS["error_rate"]
    capacity: int = BLOOM_DEFAULTS["capacity"]
    expansion: int | None = None
    nonscaling: bool = False

    def __post_init__(self):
        if not isinstance(self.error_rate, (int, float)) or not 0 < self.error_rate < 1:
            raise ValueError(f"error_rate must lie between 0 and 1, not {self.error_rate!r}")
        _whole("capacity", self.capacity, 1, MAX_CAPACITY)
        if self.expansion is not None:
            _whole("expansion", self.expansion, 0, MAX_EXPANSION)
            if self.nonscaling and self.expansion > 0:
                raise ValueError("a filter that doesn't scale has no expansion")
        if self.error_rate > MAX_ERROR:
            warnings.warn(f"error_rate {self.error_rate} is capped at {MAX_ERROR}", stacklevel=3)
            object.__setattr__(self, "error_rate", MAX_ERROR)
        if self.expansion is None:
            object.__setattr__(self, "expansion", 0 if self.nonscaling else BLOOM_DEFAULTS["expansion"])
        object.__setattr__(self, "nonscaling", self.expansion == 0)

    @property
    def link_error(self) -> float:
        """Error rate of the first link: scaling filters halve it, and again for each further link."""
        return self.error_rate if self.nonscaling else self.error_rate * 0.5

    def link(self, number: int = 0) -> tuple[int, float, int, int]:
        """(capacity, error, bits, hashes) of a link."""
        entries = self.capacity * max(1, self.expansion) ** number
        error = self.link_error * 0.5**number
        return entries, error, *bloom_size(entries, error)


def bloom_size(entries: int, error: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes for that many entries at that error rate."""
    per_entry = -math.log(error) / math.log(2) ** 2
    bits = int(entries * per_entry)
    return max(64, -(-bits // 64) * 64), math.ceil(math.log(2) * per_entry)


@dataclass(frozen=True)
class CuckooOptions:
    capacity: int = CUCKOO_DEFAULTS["capacity"]
    bucket_size: int = CUCKOO_DEFAULTS["bucket_size"]
    max_iterations: int = CUCKOO_DEFAULTS["max_iterations"]
    expansion: int = CUCKOO_DEFAULTS["expansion"]
    max_expansions: int = CUCKOO_DEFAULTS["max_expansions"]

    def __post_init__(self):
        _whole("bucket_size", self.bucket_size, 1, 255)
        _whole("max_iterations", self.max_iterations, 1, 65535)
        _whole("expansion", self.expansion, 0, MAX_EXPANSION)
        _whole("max_expansions", self.max_expansions, 1, 65536)
        _whole("capacity", self.capacity, 2 * self.bucket_size, MAX_CAPACITY)

    @property
    def buckets(self) -> int:
        return max(1, next_power_of_two(self.capacity // self.bucket_size))

    @property
    def growth(self) -> int:
        return next_power_of_two(self.expansion)


@dataclass(frozen=True)
class CmsOptions:
    width: int
    depth: int

    def __post_init__(self):
        _whole("width", self.width, 1, CELL_MAX)
        _whole("depth", self.depth, 1, CELL_MAX)

    @classmethod
    def by_probability(cls, error: float, probability: float) -> CmsOptions:
        for name, v in (("error", error), ("probability", probability)):
            if not isinstance(v, float) or not 0 < v < 1:
                raise ValueError(f"{name} must lie between 0 and 1, not {v!r}")
        return cls(math.ceil(2 / error), math.ceil(math.log10(probability) / math.log10(0.5)))


@dataclass(frozen=True)
class TopKOptions:
    k: int
    width: int = TOPK_DEFAULTS["width"]
    depth: int = TOPK_DEFAULTS["depth"]
    decay: float = TOPK_DEFAULTS["decay"]

    def __post_init__(self):
        for name in ("k", "width", "depth"):
            _whole(name, getattr(self, name), 1, CELL_MAX)
        if not 0 < self.decay <= 1:
            raise ValueError(f"decay must lie in (0, 1], not {self.decay!r}")


@dataclass(frozen=True)
class TDigestOptions:
    compression: int = COMPRESSION

    def __post_init__(self):
        _whole("compression", self.compression, 1, 1 << 30)

    @property
    def capacity(self) -> int:
        return 6 * self.compression + 10


def from_conf(kind: type, spark: SparkSession, prefix: str = "spark.sketchwell"):
    """Defaults of a kind of options, replaced by session settings such as spark.sketchwell.bloom.capacity."""
    name = kind.__name__.removesuffix("Options").lower()
    found = {}
    for field, f in kind.__dataclass_fields__.items():
        v = spark.conf.get(f"{prefix}.{name}.{field}", None)
        if v is not None:
            found[field] = v.lower() == "true" if "bool" in str(f.type) else float(v) if "float" in str(f.type) else int(v)
    return kind(**found)
