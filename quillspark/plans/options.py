"""Options of a conversion."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.ocr import Provider
from ..sources.pdf import Limits

PAGE_BREAKS = ("none", "rule", "comment", "bracket")
PROFILES = {"fast": 1024, "balanced": 256, "low_memory": 32}  # MB that the pages of a record batch may take


@dataclass(frozen=True)
class ConvertOptions:
    """dialect, deterministic and caching change no result: all dialects are written alike, conversion is deterministic, and
    caching is a matter of the frame. recognition_dpi is handed to the provider."""

    profile: str = "balanced"
    dialect: str = "gfm"
    front_matter: bool = True
    page_breaks: str = "comment"
    extract_images: bool = False
    extract_vectors: bool = False
    assets: str = "assets"  # what image links begin with
    detect_tables: bool = True
    stitch_tables: bool = True
    html_tables: bool = True  # for cells that span several columns or rows
    paragraph_gap: float = 1.4
    recognition: str = "auto"  # or always, never
    provider: Provider | None = None
    recognition_dpi: int = 150
    limits: Limits = field(default_factory=Limits)
    deterministic: bool = True
    caching: bool = True

    def __post_init__(self):
        for name, allowed in (("page_breaks", PAGE_BREAKS), ("profile", PROFILES), ("recognition", ("auto", "always", "never")), ("dialect", ("gfm", "commonmark", "extended"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
