"""Configuration and row layouts of the record-fusion engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

#: Source priority, base confidence, and what agreement, conflict and malformed input are worth.
PRIORITY = {"Resume": 90, "ATS": 85, "CSV": 80, "GitHub": 70, "Recruiter Note": 60}
BASE_CONFIDENCE = {"Resume": "0.90", "ATS": "0.85", "CSV": "0.80", "GitHub": "0.70", "Recruiter Note": "0.60"}
DEFAULT_PRIORITY, DEFAULT_BASE = 50, "0.50"
AGREEMENT_BONUS, CONFLICT_PENALTY, MALFORMED_PENALTY, SKILL_MALFORMED_PENALTY = "0.05", "0.10", "0.20", "0.30"
COMPLETENESS_PENALTY = "0.15"

SCALARS = ("full_name", "headline", "years_experience", "location")
COLLECTIONS = ("emails", "phones", "skills", "links", "education")

#: One raw value of one record. A row with a null field says only that the record exists.
EDUCATION = "STRUCT<institution: STRING, degree: STRING, field_of_study: STRING, start: STRING, end: STRING>"
RAW_VALUES = f"record_ord BIGINT, source STRING, field STRING, pos INT, raw STRING, edu {EDUCATION}, method STRING, malformed BOOLEAN"


@dataclass(frozen=True)
class FusionConfig:
    priority: dict[str, int] = field(default_factory=lambda: dict(PRIORITY))
    base: dict[str, str] = field(default_factory=lambda: dict(BASE_CONFIDENCE))
    region: str = "IN"
    fuzzy_threshold: float = 90.0
    required: tuple[str, ...] = ("skills",)
    as_of: date | None = None  # what "present" means in date ranges; today if unset


@dataclass(frozen=True)
class FieldMapping:
    canonical: str
    out: str


@dataclass(frozen=True)
class ProjectionConfig:
    """What to return: a runtime SELECT over canonical rows. missing: omit, null or empty_string."""

    name: str = "default"
    fields: tuple[FieldMapping, ...] = ()
    include_confidence: bool = False
    include_provenance: bool = False
    missing: str = "null"
