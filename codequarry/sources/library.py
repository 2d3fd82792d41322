"""Where the shared library's sources lie."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from codequarry.sources.files import ENDINGS


def has_sources(folder: str) -> bool:
    """Whether an application's `lib` under the folder, or the folder itself, has source files."""
    if not folder or not os.path.isdir(folder):
        return False
    for _, _, files in os.walk(folder):
        if any(f.endswith(ENDINGS) for f in files):
            return True
    return False


def library_root(
    explicit: str = "", override: str = "", installs: Iterable[str | Callable[[], str]] = (), stored: str = ""
) -> str:
    """The root to index, '' if there is none.

    What is named explicitly counts as it is, then an override (such as the value of an environment variable), then the
    first of the installs (folders, or functions that find one, asked in order) whose `lib` has sources, then the root
    stored by an earlier run if it still has some. The order is that of trust: a version switch is noticed before the
    stored root is believed. Nothing is executed here; callers bring functions that ask a version manager.
    """
    for named in (explicit.strip(), override.strip()):
        if named:
            return named
    for install in installs:
        folder = (install() if callable(install) else install) or ""
        candidate = os.path.join(folder, "lib") if folder else ""
        if has_sources(candidate):
            return candidate
    return stored if has_sources(stored) else ""
