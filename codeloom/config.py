"""Run settings, passed as plain arguments instead of a discovered file."""

from __future__ import annotations

from dataclasses import dataclass, field

# Names and globs that are skipped while scanning a tree.
DEFAULT_IGNORE = (
    ".git",
    "node_modules",
    "vendor",
    "__pycache__",
    "venv",
    "env",
    ".venv",
    "dist",
    "build",
    ".next",
    ".nuxt",
    "__init__.py",
    "manage.py",
    "codeloom",
    ".codeloom-cache.json",
    "*.min.js",
    "*.min.css",
    "*.lock",
    "[0-9][0-9][0-9][0-9]_*.py",
)

DEFAULT_FORMATS = ("md", "mermaid", "json")


@dataclass(frozen=True)
class AnalysisConfig:
    """Which files are analysed."""

    ignore: tuple[str, ...] = field(default=DEFAULT_IGNORE)
