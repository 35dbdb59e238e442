"""Configurations: read, merged with their presets, resolved to rules, checked.

A configuration is a nested dict: publication, writing_style, rules (category ->
rule -> ai_threshold, human_baseline, disabled, weight, expected), presets,
session.
"""

from __future__ import annotations

import json
import os
import re
from typing import Any

from .rules import DEFAULTS, PRESETS, Rules

# What a configuration may say.
MEDIA = ["blog", "book", "technical", "academic", "casual", "student", "business", "unknown"]
ALLOWED = {
    "publication.media": MEDIA,
    "publication.audience": ["general", "expert", "beginner", "mixed"],
    "publication.length": ["short_form", "medium_form", "long_form"],
    "publication.platform": ["self_published", "traditional", "web", "academic_journal", "blog_platform", "social_media"],
    "publication.editorial": ["unedited", "self_edited", "copy_edited", "professionally_edited", "peer_reviewed"],
    "writing_style.tone": ["formal", "conversational", "casual", "academic", "technical"],
    "writing_style.formality": ["formal", "informal", "mixed"],
    "writing_style.voice": ["first-person", "first-person-plural", "second-person", "third-person"],
    "writing_style.tense": ["past", "present", "mixed"],
}
ERAS = ["contemporary", "modern", "classic", "historical"]
THRESHOLD_KEYS = ["ai_threshold", "human_baseline", "disabled", "weight", "expected"]
# Deprecated names and what they are called now.
DEPRECATED = {"context": "publication", "style": "writing_style", "writingContext": "publication", "writingStyle": "writing_style"}
# Settings of a session that says nothing.
SESSION = {"max_rounds": 5, "success_mode": "any_flag", "confidence_threshold": 0.3, "preserve_structure": True, "preserve": [], "verbose": False}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z]+)", lambda m: "_" + m[1], name).lower()


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def renamed(value: Any, name) -> Any:
    """All keys of nested dicts and lists renamed by `name`."""
    if isinstance(value, dict):
        return {name(k): renamed(v, name) for k, v in value.items()}
    return [renamed(v, name) for v in value] if isinstance(value, list) else value


def merged(base: dict, layer: dict, keep_null: bool = True) -> dict:
    """layer over base, dict by dict; lists replace.  keep_null: a null in layer replaces too; else it leaves what is there."""
    out = dict(base)
    for key, value in layer.items():
        if value is None and not keep_null:
            continue
        out[key] = merged(out[key], value, keep_null) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def preset(name: str) -> dict:
    """A built-in preset as a configuration."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    rules: dict = {}
    for (category, rule), values in PRESETS[name].items():
        rules.setdefault(category, {})[rule] = {k: v for k, v in zip(THRESHOLD_KEYS, values) if v is not None}
    return {"rules": rules}


def read(path: str) -> dict:
    """A YAML or JSON file; an empty one is an empty configuration."""
    import yaml  # JSON is YAML

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path}: a configuration is a mapping")
    return found or {}


def _load(name: str, folder: str) -> tuple[dict, str]:
    path = name if os.path.isabs(name) else os.path.join(folder, name)
    return (read(path), os.path.dirname(path)) if name.endswith((".yaml", ".yml", ".json")) else (preset(name), folder)


def with_presets(config: dict, folder: str = ".", more: tuple[str, ...] = (), seen: tuple[str, ...] = ()) -> dict:
    """config over its presets in order, `more` before its own, each over its nested ones first; a preset met twice on the way is an error."""
    out: dict = {}
    for name in [*more, *config.get("presets", [])]:
        if name in seen:
            raise ValueError(f"circular preset: {' -> '.join([*seen, name])}")
        seen = (*seen, name)
        inner, place = _load(name, folder)
        out = merged(out, with_presets(inner, place, (), seen))
    return merged(out, {k: v for k, v in config.items() if k != "presets"})


def rules_of(config: dict) -> Rules:
    """The defaults with a resolved configuration's rules over them."""
    layer = {(c, r): tuple(v.get(k) for k in THRESHOLD_KEYS[:3]) for c, rules in (config.get("rules") or {}).items() for r, v in (rules or {}).items() if isinstance(v, dict)}
    return Rules(overrides=layer)


def of_media(media: str) -> dict:
    """The preset of that name, if there is one; else the defaults with the media told."""
    return merged(preset(media) if media in PRESETS else {}, {"publication": {"media": media}})


def resolve(given: str | dict | None = None, presets: tuple[str, ...] = ()) -> dict:
    """A configuration from a dict, a file's path, a medium, JSON text that names one, or a preset; from anything else that of an unknown medium."""
    if isinstance(given, dict):
        return with_presets(given, more=presets)
    text = (given or "").strip()
    if text.endswith((".yaml", ".yml", ".json")) and os.path.exists(text):
        return with_presets(read(text), os.path.dirname(text) or ".", presets)
    found = text if text in MEDIA else None
    if text.startswith("{"):
        try:
            media = json.loads(text).get("media")
            found = media if media in MEDIA else None
        except ValueError:
            pass
    if found is None and text in PRESETS:
        return merged(with_presets({}, more=presets), preset(text))
    return merged(with_presets({}, more=presets), of_media(found or "unknown"))


def session(config: dict) -> dict:
    """Session settings, each its default where nothing or null is said."""
    own = config.get("session") or {}
    return {k: v if own.get(k) is None else own[k] for k, v in SESSION.items()}


def problems(config: dict) -> list[tuple[str, str, str]]:
    """(level, path, message) of everything wrong: errors first, then warnings."""
    errors, warnings = [], []
    for path, values in ALLOWED.items():
        part, key = path.split(".")
        section = config.get(part)
        value = section.get(key) if isinstance(section, dict) else None
        if value is not None and value not in values:
            errors.append((path, f"not one of {', '.join(values)}"))
    era = (config.get("publication") or {}).get("era")
    if era is not None and era not in ERAS and not (isinstance(era, int) and not isinstance(era, bool) and 1000 <= era <= 3000):
        errors.append(("publication.era", f"not one of {', '.join(ERAS)} or a year from 1000 to 3000"))
    for old, new in DEPRECATED.items():
        if old in config:
            warnings.append((old, f"deprecated, use {new}"))
    if not isinstance(config.get("presets", []), list):
        errors.append(("presets", "not a list"))
    for category, rules in (config.get("rules") or {}).items():
        if category not in DEFAULTS:
            warnings.append((f"rules.{category}", "unknown category"))
        for rule, values in (rules or {}).items() if isinstance(rules, dict) else ():
            path = f"rules.{category}.{rule}"
            if category in DEFAULTS and rule not in DEFAULTS[category]:
                known = snake(rule) in DEFAULTS[category]
                warnings.append((path, f"deprecated, use {snake(rule)}" if known else "unknown rule"))
            for key, value in (values or {}).items() if isinstance(values, dict) else ():
                number = isinstance(value, (int, float)) and not isinstance(value, bool)
                if key not in THRESHOLD_KEYS:
                    warnings.append((f"{path}.{key}", f"deprecated, use {snake(key)}" if snake(key) in THRESHOLD_KEYS else "unknown key"))
                elif key == "disabled" and not isinstance(value, bool):
                    errors.append((f"{path}.{key}", "not true or false"))
                elif key in ("ai_threshold", "human_baseline", "weight") and not number:
                    errors.append((f"{path}.{key}", "not a number"))
                elif key == "weight" and not 0 <= value <= 1:
                    warnings.append((f"{path}.{key}", "not between 0 and 1"))
    return [("error", *e) for e in errors] + [("warning", *w) for w in warnings]
