"""All query modules outside the optional subpackage."""

from __future__ import annotations

from . import Entry, anchors, axes, features, graph, jobs, lexicon, parsing, signals, skew, text, vectors

MODULES = [skew, text, graph, lexicon, vectors, axes, anchors, parsing, jobs, features, signals]


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for m in MODULES:
        twice = out.keys() & m.registry.keys()
        if twice:
            raise ValueError(f"queries registered twice: {sorted(twice)}")
        out |= m.registry
    return out
