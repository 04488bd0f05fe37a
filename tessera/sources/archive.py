"""A submission's files and code in one archive; local files only."""

from __future__ import annotations

import zipfile
from pathlib import Path

__all__ = ["bundle"]


def bundle(out: str, required: list[str], code: str) -> list[str]:
    """Writes a zip of the required files (by their names) and of the code folder; returns its member names.

    Caches, compiled files and names that begin with a dot stay out.  The archive appears only once it is whole.
    """
    files = [Path(p) for p in required]
    if missing := [str(p) for p in files if not p.is_file()]:
        raise FileNotFoundError(", ".join(missing))
    base = Path(code)
    inside = [p for p in sorted(base.rglob("*")) if p.is_file() and p.suffix != ".pyc" and not any(x == "__pycache__" or x.startswith(".") for x in p.relative_to(base).parts)]
    members = [(p, p.name) for p in files] + [(p, f"{base.name}/{p.relative_to(base).as_posix()}") for p in inside]
    part = Path(f"{out}.tmp")
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as archive:
        for p, name in members:
            archive.write(p, name)
    part.replace(out)
    return [name for _, name in members]
