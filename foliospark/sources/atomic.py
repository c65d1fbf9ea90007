"""Whole-file writes that appear at once or not at all."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterable


def write_text(path: str, content: str | Iterable[str]) -> None:
    """Replaces a file by UTF-8 text as it is: a sibling is written, flushed and renamed, and removed on any error."""
    folder, name = os.path.split(os.path.abspath(path))
    handle, part = tempfile.mkstemp(prefix=f".{name}.", suffix=".part", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.writelines([content] if isinstance(content, str) else content)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(part, 0o644)
        os.replace(part, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)
        raise
