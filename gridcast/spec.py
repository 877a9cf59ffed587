"""What a series is: its keys, its clock and how it is cut into chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def floor_div(x: Column, n: int) -> Column:
    """Floor of ``x / n`` for integers; exact, as the dividend is a multiple of n."""
    return ((x - F.pmod(x, F.lit(n))) / F.lit(n)).cast("long")


@dataclass(frozen=True)
class SeriesSpec:
    """Describes a table of time series.

    keys        columns naming the entity (rack, device, user); may be empty
    ts          timestamp column
    step_s      grid cadence in seconds; needed by grid operators
    origin_us   where bin 0 starts; only needed when the step does not divide a day
    gap_free    True when every grid step between an entity's first and last row
                is present (the output of ``resample_mean``). Row positions are
                then the grid index; otherwise they are counted.
    chunk_rows  rows of one entity that one window group holds (plus the halo)
    bucket_s    time span sorted as one group when positions must be counted
    max_bucket_rows  a span of one entity with more rows is cut into finer ones
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    step_s: float | None = None
    origin_us: int = 0
    gap_free: bool = False
    chunk_rows: int = 4096
    bucket_s: float | None = None
    max_bucket_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if self.gap_free and self.step_s is None:
            raise ValueError("a gap-free series needs step_s")
        if self.step_s is not None and self.step_s <= 0:
            raise ValueError("step_s must be positive")
        if self.chunk_rows < 1:
            raise ValueError("chunk_rows must be at least 1")

    @property
    def step_us(self) -> int:
        if self.step_s is None:
            raise ValueError("this operator needs step_s")
        return int(round(self.step_s * 1_000_000))

    @property
    def bucket_us(self) -> int:
        if self.bucket_s is not None:
            return max(1, int(round(self.bucket_s * 1_000_000)))
        if self.step_s is not None:
            return self.step_us * self.chunk_rows
        return 3_600_000_000

    def micros(self) -> Column:
        return F.unix_micros(F.col(self.ts).cast("timestamp"))

    def index(self) -> Column:
        """Left-labelled grid index of a row.

        Bins start at midnight, which is the epoch grid only for steps that
        divide a day; other steps must say where the grid starts.
        """
        if DAY_US % self.step_us and not self.origin_us:
            raise ValueError("step does not divide a day: set origin_us")
        return floor_div(self.micros() - F.lit(self.origin_us), self.step_us)

    def index_to_ts(self, index: Column) -> Column:
        return F.timestamp_micros(index * F.lit(self.step_us) + F.lit(self.origin_us))

    def replace(self, **changes) -> SeriesSpec:
        return SeriesSpec(**{**self.__dict__, **changes})
