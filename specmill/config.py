"""Settings of the comparison pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """All constants that steer the pipeline; pass a changed copy to alter it."""

    fill_label: str = "Funzioni AI"
    most_cells: int = 90
    most_extra_pages: int = 15
    keyword_overlap: float = 0.26
    top_keywords: int = 30
    score_high: int = 75
    score_low: int = 55
    least_tokens: int = 2
    docx_characters: int = 3000
    base_url_mark: str = "DOC_FLOTTE"
    base_url_host: str = "sharepoint.com"
    #: Reproduce that an unreadable answer of the model, with enough differences, ends as "different".
    strict_uncertain: bool = False
