"""Settings, profiles and taxonomies: small driver-side values that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Fixed values of the domain model.
ACTIONS = ("insert", "possible_duplicate", "reject")
IN_REVIEW, APPROVED, UPLOADED, DISCARDED, DELETED = "en-revision", "aprobada", "subida", "descartada", "borrada-en-anki"
REMOVED = (DISCARDED, DELETED)
UNRESOLVED = "_unresolved::"


@dataclass(frozen=True)
class Settings:
    cluster_threshold: float = 0.90
    similar_threshold: float = 0.75
    include_subdecks: bool = True
    default_deck: str = "Cloud Certs"
    default_model: str = "Basic"
    model_aliases: dict[str, str] = field(default_factory=dict)
    front_field: str = "Front"
    back_field: str = "Back"
    use_language_model: bool = False


@dataclass(frozen=True)
class Taxonomy:
    """Ordered categories, each with ordered values; names are trimmed, blanks and repeats dropped."""

    categories: dict[str, tuple[str, ...]]

    @staticmethod
    def of(raw: dict[str, Any]) -> Taxonomy:
        out: dict[str, tuple[str, ...]] = {}
        for name, values in raw.items():
            if not isinstance(values, (list, tuple)):
                raise ValueError(f"category {name!r}: expected a list of values")
            out[str(name).strip()] = tuple(dict.fromkeys(v for v in (str(x).strip() for x in values if x is not None) if v))
        return Taxonomy(out)

    def tags(self) -> list[str]:
        return [f"{c}::{v}" for c, values in self.categories.items() for v in values]

    def add(self, category: str, value: str) -> Taxonomy:
        """With a value appended to a category unless it is there already; a new category goes last."""
        held = self.categories.get(category, ())
        return self if value in held else Taxonomy(self.categories | {category: (*held, value)})


@dataclass(frozen=True)
class Profile:
    """A rule pack; the order of every mapping and list matters: the first rule that fits wins."""

    required_categories: tuple[str, ...] = ("vendor", "topic", "type")
    routing_categories: tuple[str, ...] = ("cert", "vendor")
    keyword_rules: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    topic_keywords: dict[str, list[str]] = field(default_factory=dict)
    deck_tag_rules: dict[str, dict[str, str]] = field(default_factory=dict)
    type_patterns: dict[str, list[str]] = field(default_factory=lambda: dict(TYPE_PATTERNS))

    def merged(self, override: dict[str, Any]) -> Profile:
        """With the non-empty parts of ``override``: lists replace, rule mappings merge by key."""
        parts: dict[str, Any] = {}
        for name in self.__dataclass_fields__:
            own, new = getattr(self, name), override.get(name)
            parts[name] = own if not new else (own | new if isinstance(own, dict) else tuple(new))
        return Profile(**parts)


# Question types by patterns over accent-free lower-case text, in order (fixed values).
TYPE_PATTERNS: dict[str, list[str]] = {
    "acronym": [r"\bque significa\b", r"\bwhat does .+ stand for\b", r"\bsiglas?\b"],
    "definition": [r"\bque es\b", r"\bwhat is\b", r"\bdefine\b", r"\bdescribe\b", r"\bexplain\b", r"\bexplica\b"],
    "comparison": [r"\bdiferencia entre\b", r"\bdifference between\b", r"\bcompare\b", r"\bcompara\b", r"\bvs\b", r"\bversus\b"],
    "command": [r"\bcomando\b", r"\bcommand\b", r"\bcli\b", r"\bsyntax\b", r"\bvault [a-z0-9_-]+\b", r"\bterraform [a-z0-9_-]+\b"],
    "scenario": [r"\ba company\b", r"\bscenario\b", r"\bbest for\b", r"\buse case\b", r"\bnecesita\b", r"\bneeds to\b"],
}


def load_yaml(path: str) -> Any:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def save_taxonomy(taxonomy: Taxonomy, path: str) -> None:
    """YAML with the order of categories and values kept."""
    import yaml

    Path(path).write_text(yaml.safe_dump({c: list(v) for c, v in taxonomy.categories.items()}, sort_keys=False, allow_unicode=True), encoding="utf-8")


def load_settings(path: str) -> Settings:
    """Settings from YAML; names that aren't settings are ignored, what isn't given has its default."""
    raw = load_yaml(path) or {}
    return Settings(**{k: v for k, v in raw.items() if k in Settings.__dataclass_fields__})


def load_taxonomy(path: str) -> Taxonomy:
    return Taxonomy.of(load_yaml(path) or {})


def load_profile(path: str, base: Profile | None = None) -> Profile:
    """A rule pack from YAML on top of another."""
    return (base or Profile()).merged(load_yaml(path) or {})
