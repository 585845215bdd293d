"""Managed blocks: markers, their spans, text and differences; and YAML rewrites.

A block lies between ``<!-- TOOL:KIND target=NAME -->`` and its end marker
``<!-- /TOOL:KIND target=NAME -->``, each on a line of its own outside fenced code.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import yaml

from corpusloom.functions.markdown import LIST_RELATIONS, UniqueKeys, fenced, universal_newlines

_MARKER = re.compile(r"<!--\s*(/?)[a-z]+:(source|managed)\s+target=([A-Za-z][A-Za-z0-9_-]*)\s*-->\s*")
_LIKE = re.compile(r"\s*<!--\s*/?[a-z]+:(?:source|managed)\b")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def scan_markers(text: str, target: str) -> tuple[list[Span], list[str]]:
    """Well-formed spans of a target in the order of their ends, and what is wrong."""
    lines = text.splitlines()
    open_: list[tuple[str, int]] = []
    spans: list[Span] = []
    issues: list[str] = []
    for number, (line, code) in enumerate(zip(lines, fenced(lines), strict=True), 1):
        if code:
            continue
        mark = _MARKER.fullmatch(line)
        if mark is None:
            if _LIKE.match(line) and re.search(rf"target\s*=\s*[\"']?{re.escape(target)}(?![\w-])", line):
                issues.append(f"malformed marker at line {number}")
        elif mark[3] == target and not mark[1]:
            open_.append((mark[2], number))
        elif mark[3] == target and not open_:
            issues.append(f"end without start at line {number}")
        elif mark[3] == target and open_[-1][0] != mark[2]:
            issues.append(f"crossed markers at lines {open_[-1][1]} and {number}")
        elif mark[3] == target:
            kind, start = open_.pop()
            spans.append(Span(kind, start, number))
    return spans, issues + [f"start without end at line {n}" for _, n in open_]


def resolve_marker(text: str, target: str, kind: str, within: tuple[int, int] | None = None) -> Span:
    """The one span of a kind, if need be inside a section's lines; else an error."""
    spans, issues = scan_markers(text, target)
    if issues:
        raise ValueError("; ".join(issues))
    own = [s for s in spans if s.kind == kind and (within is None or (within[0] <= s.start and s.end <= within[1]))]
    if len(own) != 1:
        raise ValueError(f"{len(own)} {kind} blocks of {target}")
    return own[0]


def block_text(text: str, span: Span) -> str:
    """The exact text between the markers, line ends included."""
    return "".join(text.splitlines(keepends=True)[span.start : span.end - 1])


def replace_block(text: str, span: Span, body: str) -> str:
    lines = text.splitlines(keepends=True)
    return "".join([*lines[: span.start], body, *lines[span.end - 1 :]])


def block_diff(old: str, new: str, old_name: str = "current", new_name: str = "source") -> str:
    return "".join(difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), old_name, new_name))


def changed_spans(old: str, new: str) -> list[tuple[int, int]]:
    """1-based line ranges of the old text that a change touches; an insert touches the line before it."""
    match = difflib.SequenceMatcher(None, old.splitlines(keepends=True), new.splitlines(keepends=True), autojunk=False)
    return [(a + 1, b) if a < b else (max(a, 1), max(a, 1)) for tag, a, b, _, _ in match.get_opcodes() if tag != "equal"]


def outside_ranges(old: str, new: str, allowed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Changes that no allowed range of lines contains."""
    return [(a, b) for a, b in changed_spans(old, new) if not any(x <= a and b <= y for x, y in allowed)]


def rewrite_relations(text: str, targets: dict[str, str]) -> str:
    """Replaces relation values in the front matter, character by character where they are.

    Only scalars of list relations change; comments, order and quoting elsewhere stay.
    """
    text = universal_newlines(text)
    lines = text.splitlines(keepends=True)
    if not lines or lines[0].strip() != "---":
        return text
    close = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
    if close is None:
        return text
    head, body, tail = lines[0], "".join(lines[1:close]), "".join(lines[close:])
    root = yaml.compose(body, Loader=UniqueKeys)
    edits: dict[tuple[int, int], str] = {}
    if isinstance(root, yaml.MappingNode):
        for key, value in root.value:
            if key.value in LIST_RELATIONS and isinstance(value, yaml.SequenceNode):
                for item in value.value:
                    if isinstance(item, yaml.ScalarNode) and item.value in targets:
                        edits[item.start_mark.index, item.end_mark.index] = targets[item.value]
    for (a, b), new in sorted(edits.items(), reverse=True):
        body = body[:a] + new + body[b:]
    return head + body + tail
