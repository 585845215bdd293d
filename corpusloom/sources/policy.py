"""Project policy: a strict TOML file read on the driver into frozen values."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

CONFIG_NAME = "corpusloom.toml"
WORKSPACE_NAME = "corpusloom-workspace.toml"


class PolicyError(ValueError):
    """A policy, registry or request that does not have the required form."""


@dataclass(frozen=True)
class SnapshotRule:
    doc_type: str
    statuses: tuple[str, ...]


@dataclass(frozen=True)
class Profile:
    name: str
    doc_type: str
    required_metadata: tuple[str, ...] = ()
    required_roles: tuple[tuple[str, tuple[str, ...]], ...] = ()
    relations: tuple[str, ...] | None = None
    statuses: tuple[str, ...] | None = None


@dataclass(frozen=True)
class View:
    direction: str = "forward"
    relations: tuple[str, ...] = ("depends_on", "derived_from", "validated_against")
    depth: int = 1


@dataclass(frozen=True)
class Policy:
    root: str = "plan"
    language: str = "en"
    areas: tuple[tuple[str, str], ...] = ((".", "."),)  #: (role, folder)
    prefixes: frozenset[str] = frozenset({"DOC", "DEC", "RM"})
    exclude: tuple[str, ...] = ()
    extend_through: tuple[str, ...] = ()
    legacy_paths: str = "strict"
    snapshot_types: tuple[str, ...] = ()
    snapshot_rules: tuple[SnapshotRule, ...] = ()
    required_metadata: tuple[str, ...] = ()
    report_orphans: bool = False
    thresholds: tuple[tuple[str, int], ...] = ()  #: (signal code, least value)
    profiles: tuple[Profile, ...] = ()
    views: tuple[tuple[str, View], ...] = ()
    delivery_types: tuple[str, ...] = ()
    delivery_field: str = "delivers"
    evidence_roles: tuple[tuple[str, tuple[str, ...]], ...] = ()
    keep_generations: int = 2
    rules: tuple[tuple[str, Any], ...] = field(default=(), compare=False)

    def fingerprint(self) -> str:
        """A hash of all that a snapshot depends on."""
        own = asdict(self)
        own.pop("keep_generations"), own.pop("rules")
        own["prefixes"] = sorted(self.prefixes)
        return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()


def _texts(table: dict, key: str) -> tuple[str, ...]:
    value = table.get(key, [])
    if not isinstance(value, list) or not all(isinstance(v, str) and v for v in value):
        raise PolicyError(f"{key} must be a list of texts")
    return tuple(value)


def _only(table: dict, allowed: set[str], where: str) -> None:
    if extra := sorted(set(table) - allowed):
        raise PolicyError(f"{where} has unknown keys: {', '.join(extra)}")


def parse_policy(raw: dict[str, Any]) -> Policy:
    """A policy from parsed TOML; unknown keys and wrong types raise ``PolicyError``."""
    _only(raw, {"version", "documentation", "areas", "identifiers", "catalog", "navigation", "relations", "graph_health", "profiles", "views", "traceability", "projection", "workstreams", "intake", "admission", "maintenance", "federation"}, "the policy")
    if raw.get("version") != 1:
        raise PolicyError("version must be 1")
    documentation, relations, health = (raw.get(k, {}) for k in ("documentation", "relations", "graph_health"))
    _only(relations, {"legacy_paths", "snapshot_types", "snapshot_rules"}, "relations")
    if relations.get("legacy_paths", "strict") not in ("strict", "boundary", "resolve"):
        raise PolicyError("relations.legacy_paths must be strict, boundary or resolve")
    areas = raw.get("areas", {".": "."})
    for folder in areas.values():
        if not isinstance(folder, str) or folder.startswith("/") or ".." in folder.split("/"):
            raise PolicyError(f"area {folder!r} must be a relative folder")
    prefixes = raw.get("identifiers", {"document": "DOC", "decision": "DEC", "roadmap": "RM"}).values()
    if not all(isinstance(p, str) and re.fullmatch(r"[A-Z][A-Z0-9]{1,15}", p) for p in prefixes):
        raise PolicyError("identifiers must be upper-case prefixes")
    profiles = []
    for name, p in sorted(raw.get("profiles", {}).items()):
        _only(p, {"type", "required_metadata", "required_roles", "relations", "statuses"}, f"profile {name}")
        roles = tuple((r, tuple(a)) for r, a in sorted(p.get("required_roles", {}).items()))
        profiles.append(Profile(name, p.get("type", name), _texts(p, "required_metadata"), roles, *(tuple(p[k]) if k in p else None for k in ("relations", "statuses"))))
    views = []
    for name, v in sorted(raw.get("views", {}).items()):
        if v.get("direction", "forward") not in ("forward", "reverse", "both") or not 0 <= v.get("depth", 1) <= 5:
            raise PolicyError(f"view {name} has a wrong direction or depth")
        views.append((name, View(v.get("direction", "forward"), tuple(v.get("relations", View.relations)), v.get("depth", 1))))
    trace = raw.get("traceability", {})
    thresholds = {k: v for k, v in health.items() if k not in ("required_metadata", "report_orphans")}
    if not all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in thresholds.values()):
        raise PolicyError("graph_health thresholds must be whole numbers")
    return Policy(
        root=documentation.get("root", "plan"),
        language=documentation.get("language", "en"),
        areas=tuple(sorted(areas.items())),
        prefixes=frozenset(prefixes),
        exclude=_texts(raw.get("catalog", {}), "exclude"),
        extend_through=_texts(raw.get("navigation", {}), "extend_through"),
        legacy_paths=relations.get("legacy_paths", "strict"),
        snapshot_types=_texts(relations, "snapshot_types"),
        snapshot_rules=tuple(SnapshotRule(r["type"], tuple(r.get("statuses", ()))) for r in relations.get("snapshot_rules", [])),
        required_metadata=_texts(health, "required_metadata"),
        report_orphans=bool(health.get("report_orphans", False)),
        thresholds=tuple(sorted(thresholds.items())),
        profiles=tuple(profiles),
        views=tuple(views),
        delivery_types=_texts(trace, "types"),
        delivery_field=trace.get("field", "delivers"),
        evidence_roles=tuple((r, tuple(a)) for r, a in sorted(trace.get("evidence_roles", {}).items())),
        keep_generations=raw.get("projection", {}).get("keep_generations", 2),
        rules=tuple((k, raw[k]) for k in ("workstreams", "intake", "admission", "maintenance") if k in raw),
    )


def load_policy(project: str | Path) -> Policy:
    """The policy of a project folder on the driver."""
    try:
        return parse_policy(tomllib.loads((Path(project) / CONFIG_NAME).read_text("utf-8")))
    except (OSError, tomllib.TOMLDecodeError, AttributeError, KeyError, TypeError) as error:
        raise PolicyError(f"{CONFIG_NAME}: {error}") from error


# Workspaces --------------------------------------------------------------------
@dataclass(frozen=True)
class Source:
    name: str
    root: Path


def load_workspace(root: str | Path) -> tuple[Source, ...]:
    """Registered sources: unique names, inside the workspace, none within another."""
    root = Path(root).resolve()
    try:
        raw = tomllib.loads((root / WORKSPACE_NAME).read_text("utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise PolicyError(f"{WORKSPACE_NAME}: {error}") from error
    out: list[Source] = []
    for name, folder in sorted(raw.get("sources", {}).items()):
        if not re.fullmatch(r"[a-z][a-z0-9-]{0,31}", name):
            raise PolicyError(f"source name {name!r} is not lower-case")
        at = (root / folder).resolve()
        if not at.is_relative_to(root):
            raise PolicyError(f"source {name} lies outside the workspace")
        if other := next((s for s in out if at.is_relative_to(s.root) or s.root.is_relative_to(at)), None):
            raise PolicyError(f"sources {other.name} and {name} overlap")
        out.append(Source(name, at))
    if not out:
        raise PolicyError("the workspace has no sources")
    return tuple(out)


def source_status(source: Source) -> tuple[str, str | None]:
    """(available or unavailable, reason) of a source; policies are read, corpora are not."""
    if not source.root.is_dir():
        return "unavailable", "missing-root"
    if not (source.root / CONFIG_NAME).is_file():
        return "unavailable", "missing-configuration"
    try:
        policy = load_policy(source.root)
    except PolicyError:
        return "unavailable", "invalid-configuration"
    if not (source.root / policy.root).resolve().is_relative_to(source.root):
        return "unavailable", "unsafe-local-path"
    return "available", None


def discover_workspace(option: str | None = None, start: str | Path = ".") -> Path:
    """The workspace by option, else environment, else a pointer file; else an error.

    A variable that is set but empty is an error, and not passed over.
    """
    named = option if option is not None else os.environ.get("CORPUSLOOM_WORKSPACE")
    if named is not None:
        if not named.strip():
            raise PolicyError("the workspace is named by an empty text")
        found = Path(named).expanduser()
    else:
        pointer = Path(start) / ".corpusloom-workspace"
        if not pointer.is_file():
            raise PolicyError("no workspace is named")
        found = (Path(start) / pointer.read_text("utf-8").strip()).resolve()
    if not (found / WORKSPACE_NAME).is_file():
        raise PolicyError(f"{found} has no {WORKSPACE_NAME}")
    return found


def resolve_source(name: str, option: str | None = None, start: str | Path = ".") -> Source:
    """One available source of the workspace; another name or state is an error, never another source."""
    source = next((s for s in load_workspace(discover_workspace(option, start)) if s.name == name), None)
    if source is None:
        raise PolicyError(f"the workspace has no source {name}")
    state, reason = source_status(source)
    if state != "available":
        raise PolicyError(f"source {name} is unavailable: {reason}")
    return source


def described(policy: Policy) -> list[tuple[str, str]]:
    """(key, value) of a policy as it holds, defaults included, in the order of the keys."""
    shown: dict[str, object] = {"documentation_root": policy.root, "language": policy.language, "relations.legacy_paths": policy.legacy_paths, "projection.keep_generations": policy.keep_generations}
    shown |= {f"area.{role}": folder for role, folder in policy.areas}
    shown |= {f"identifier.{p}": p for p in policy.prefixes}
    shown |= {f"catalog.exclude.{i}": p for i, p in enumerate(policy.exclude)}
    shown |= {f"navigation.extend_through.{i}": a for i, a in enumerate(policy.extend_through)}
    shown |= {f"relations.snapshot_type.{t}": t for t in policy.snapshot_types}
    shown |= {f"relations.snapshot_rule.{r.type}": ",".join(r.statuses) or "-" for r in policy.snapshot_rules}
    shown |= {f"graph_health.{code}": least for code, least in policy.thresholds}
    shown |= {"graph_health.required_metadata": ",".join(policy.required_metadata) or "-", "graph_health.report_orphans": str(policy.report_orphans).lower()}
    shown |= {f"view.{name}": f"{v.direction},{v.depth},{','.join(v.relations) or '-'}" for name, v in policy.views}
    shown |= {f"profile.{p.name}": f"type:{p.doc_type},metadata:{','.join(p.required_metadata) or '-'},roles:{','.join(r for r, _ in p.required_roles) or '-'}" for p in policy.profiles}
    if policy.delivery_types:
        shown["traceability"] = f"{policy.delivery_field},{','.join(policy.delivery_types)}"
    return sorted((k, str(v)) for k, v in shown.items())


def initialize(project: str | Path, language: str = "en") -> Path:
    """A first policy for a folder that has none, and the folder of its documents."""
    at = Path(project) / CONFIG_NAME
    with at.open("x", encoding="utf-8") as out:  # an existing one is never overwritten
        out.write(f'version = 1\n\n[documentation]\nroot = "plan"\nlanguage = {json.dumps(language)}\n')
    (Path(project) / "plan").mkdir(exist_ok=True)
    return at
