"""Names of tools that an agent may be given: built-in ones, which are guarded, and registered ones."""

from __future__ import annotations

from collections.abc import Callable

# fixed values: names of the agent framework's own tools
BUILT_IN = ["apply_patch", "browser_use", "delegate", "file_editor", "glob", "grep", "planning_file_editor", "preset", "task_tracker", "terminal", "tom_consult"]
REGISTRY: dict[str, Callable] = {}


def tool(name: str) -> Callable:
    """Register a tool's builder under a name of its own; a later one of the same name replaces it."""
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is a built-in tool and can't be replaced")

    def keep(builder: Callable) -> Callable:
        REGISTRY[name] = builder
        return builder

    return keep


def exists(name: str) -> bool:
    return name in BUILT_IN or name in REGISTRY


def check(name: str) -> None:
    if not exists(name):
        raise ValueError(f"unknown tool {name!r}; known: {', '.join(sorted([*BUILT_IN, *REGISTRY]))}")
