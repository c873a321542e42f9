"""Settings of the engine: the site whose records are read, keyword lists and caps."""

from __future__ import annotations

from dataclasses import dataclass, field

# Keyword lists of the employment intent, categories and their columns.
PRIMARY_KEYWORDS = ["desarrollador", "web", "SEO", "wordpress", "full-stack", "full stack", "PHP", "developer"]
SECONDARY_KEYWORDS = [
    "búsqueda", "oportunidad", "nueva oportunidad", "nueva oportunidad de empleo", "estamos buscando",
    "estamos buscando talento", "manda tu cv", "enviar cv", "send your cv", "we're hiring",
    "we are looking for a", "diseñador", "desarrollador", "programador", "analista de sistemas",
]
HASHTAGS = ["#empleo", "#trabajo", "#hiring", "#recruitment", "#itrecruitment", "#talentacquisition"]
CATEGORIES = [
    "jobs", "job_details", "people", "person_profiles", "posts_feed", "posts_companies", "company_search",
    "company_profiles", "company_employees", "authors",
]
#: Categories that pass the intent filter unchecked.
UNCHECKED = ("people", "company_profiles")


@dataclass(frozen=True)
class Site:
    """The network whose records are collected."""

    host: str = "https://www.vinculared.example"
    #: Words of its page foot; a listing ends there.
    foot: str = "Vinculared Corporation"
    #: The title it gives to a posting without one.
    untitled: str = "Vinculared Job"


@dataclass(frozen=True)
class EngineConfig:
    site: Site = field(default_factory=Site)
    primary: tuple[str, ...] = tuple(PRIMARY_KEYWORDS)
    secondary: tuple[str, ...] = tuple(SECONDARY_KEYWORDS)
    hashtags: tuple[str, ...] = tuple(HASHTAGS)
    name_threshold: float = 0.85
    page_size: int = 25
    detail_caps: tuple[tuple[str, int], ...] = (("jobs", 20), ("people", 15), ("companies", 8))
    slugs_per_search: int = 3
    text_enrich_cap: int = 10
    cell_limit: int = 32_000
