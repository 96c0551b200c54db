"""What a user looks for: terms, places, scale and limits, as plain fixed-size settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.places import LocationRule, check_rules
from ..operators.quality import check_bands


@dataclass(frozen=True)
class Band:
    """One named stretch of the 0 to 100 scale."""

    name: str
    low: int
    high: int


@dataclass(frozen=True)
class RepeatRules:
    """When a shown job sinks, when it hides, and what counts as a change. No hidden defaults."""

    demote_after: int
    suppress_after: int
    reset_on_score_delta: int
    enabled: bool = True


@dataclass(frozen=True)
class SearchProfile:
    """Term lists keep their order: the first match is the one reported."""

    title_include: list[str]
    strong: list[str]
    title_exclude: list[str] = field(default_factory=list)
    supporting: list[str] = field(default_factory=list)
    seniority_exclude: list[str] = field(default_factory=list)
    priority: list[LocationRule] = field(default_factory=list)
    acceptable: list[LocationRule] = field(default_factory=list)
    bands: list[Band] = field(default_factory=list)
    threshold: int = 70
    max_scores_per_run: int | None = None
    prompt_version: int = 1

    def problems(self) -> list[str]:
        """Everything that makes this profile unusable; empty when it is fine."""
        found = []
        if not self.title_include or not self.strong:
            found.append("title_include and strong must not be empty")
        if not self.priority:
            found.append("at least one priority rule is needed")
        if not 0 <= self.threshold <= 100:
            found.append("threshold must lie in 0..100")
        if (self.max_scores_per_run is not None and self.max_scores_per_run < 1) or self.prompt_version < 1:
            found.append("max_scores_per_run and prompt_version start at 1")
        found += check_rules([*self.priority, *self.acceptable])
        if self.bands:
            found += check_bands([(b.name, b.low, b.high) for b in self.bands])
        return found


def band_name(meaning: str) -> str:
    """The name of a band from its description: the first line up to its first period."""
    return meaning.strip().splitlines()[0].split(".")[0].strip()


def profile_from_settings(settings: dict) -> SearchProfile:
    """A profile from the nested mapping a settings file holds.

    Sections: titles, keywords, seniority, location and scoring. Unknown sections are
    refused so that a typo does not pass silently.
    """
    unknown = set(settings) - {"titles", "keywords", "seniority", "location", "scoring"}
    if unknown:
        raise ValueError(f"Unknown section(s): {', '.join(sorted(unknown))}")
    titles, words = settings["titles"], settings["keywords"]
    where, scoring = settings["location"], settings["scoring"]

    def rules(name: str) -> list[LocationRule]:
        return [LocationRule(tuple(r["work_modes"]), tuple(r["regions"])) for r in where.get(name, [])]

    profile = SearchProfile(
        title_include=titles["include"],
        title_exclude=titles.get("exclude", []),
        strong=words["strong"],
        supporting=words.get("supporting", []),
        seniority_exclude=settings.get("seniority", {}).get("exclude", []),
        priority=rules("priority"),
        acceptable=rules("acceptable"),
        bands=[Band(band_name(b["meaning"]), b["low"], b["high"]) for b in scoring.get("bands", [])],
        threshold=scoring["threshold"],
        max_scores_per_run=scoring["max_llm_scores_per_run"],
        prompt_version=scoring.get("prompt_version", 1),
    )
    rights = where.get("work_authorization", {})
    both = set(rights.get("have", [])) & set(rights.get("need_sponsorship", []))
    problems = profile.problems() + [f"{r}: listed as authorised and as needing sponsorship" for r in sorted(both)]
    if problems:
        raise ValueError("; ".join(problems))
    return profile
