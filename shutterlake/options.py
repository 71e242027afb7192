"""Options of the commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

#: Folder of records within a library, and the endings of what lies in it.
META_DIR, RECORD_END, REPORT_NAME, EMBEDDINGS = ".shutterlake", ".record.json", "report.csv", "embeddings.parquet"
#: Vectors that were made elsewhere: a numpy matrix and the list of its rows' names.
EMBEDDINGS_MATRIX, EMBEDDINGS_NAMES = "embeddings.npy", "embeddings.paths.json"


@dataclass(frozen=True)
class IngestOptions:
    source: str
    destination: str | None = None
    mode: str = "takeout"
    dry_run: bool = False
    skip_dedupe: bool = False
    skip_metadata_write: bool = False
    fuzzy: bool = True
    fuzzy_threshold: int = 40
    #: A source type; any other text keeps all copies.
    prefer: str = "album"

    def __post_init__(self) -> None:
        if self.mode not in ("takeout", "archive"):
            raise ValueError("the mode is takeout or archive")
        if not self.dry_run and not self.destination:
            raise ValueError("a destination is needed unless it is a dry run")


@dataclass(frozen=True)
class ExportOptions:
    force: bool = False
    dry_run: bool = False


@dataclass(frozen=True)
class EnrichOptions:
    video_frames: int = 5
    image_batch: int = 32
    dry_run: bool = False


@dataclass(frozen=True)
class CaptionOptions:
    model: str = "llava"
    video_frames: int = 5
    #: Longest edge of the pictures that are sent to the model, and their JPEG quality.
    longest_edge: int = 768
    quality: int = 90
    server: str = "http://127.0.0.1:11434"
    timeout_seconds: float = 300.0
