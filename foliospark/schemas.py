"""Schemas of the datamart tables and of the seven measurement tables."""

from __future__ import annotations

from dataclasses import dataclass

BOOKS = "book_id long, title string, author string, language string, capture_date string, header_path string, body_path string"
FETCHED = "book_id long, header string, body string, source_url string, downloaded_at timestamp"
TOKENS = "book_id long, pos int, term string"
POSTINGS = "term string, book_id long"
INDEX = "term string, postings array<long>"
CONTROL_LOG = "book_id long, state string, seq long"
QUERIES = "query_id int, ordinal int, term string"


@dataclass(frozen=True)
class Field:
    """A column of a measurement table: text, or a number that is written with some decimals."""

    name: str
    decimals: int | None = None
    key: bool = False
    needed: bool = False  # a row without it is dropped
    over_zero: bool = False  # and so is one where it isn't over 0


@dataclass(frozen=True)
class Measurement:
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def keys(self) -> list[str]:
        return [f.name for f in self.fields if f.key]

    @property
    def written(self) -> dict[str, int]:
        return {f.name: f.decimals for f in self.fields if f.decimals is not None}

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.needed]

    @property
    def positive(self) -> list[str]:
        return [f.name for f in self.fields if f.over_zero]


def _needed(**decimals: int) -> tuple[Field, ...]:
    return tuple(Field(name, n, needed=True) for name, n in decimals.items())


_TEST = Field("test_name", key=True)
_RUN = (
    Field("elapsed_seconds", 6, needed=True, over_zero=True),
    *_needed(stdev_seconds=6, repetitions=0, memory_mb=4, cpu_percent=2, peak_rss_mb=4),
)

#: The seven measurement tables.
METRICS = {
    "benchmarks": Measurement((_TEST, *_needed(elapsed_seconds=6, memory_mb=4, cpu_percent=2))),
    "disk_usage": Measurement((Field("path", key=True), *_needed(size_mb=4, file_count=0, dir_count=0))),
    "recovery": Measurement((
        _TEST, Field("total_books", 0, needed=True, over_zero=True),
        *_needed(processed_before_interruption=0, processed_after_resume=0, duplicated=0, lost=0),
        Field("detection_time", 6), Field("processing_time", 6), Field("elapsed_seconds", 6),
    )),
    "scalability": Measurement((_TEST, Field("batch_size", 0, key=True, needed=True, over_zero=True), *_RUN)),
    "updates": Measurement((_TEST, Field("base_size", 0, key=True, needed=True, over_zero=True), *_RUN)),
    "statistics": Measurement((
        _TEST, Field("iterations", 0), Field("mean_seconds", 6, needed=True, over_zero=True),
        *_needed(stdev_seconds=6, min_seconds=6, max_seconds=6),
    )),
    "throughput": Measurement((
        _TEST, Field("item_count", 0, needed=True), Field("elapsed_seconds", 6), Field("items_per_second", 4, needed=True, over_zero=True),
    )),
}
