"""The shelf: a register of the maps that were made, its page, and where a map goes."""

from __future__ import annotations

import html
import json
import os
import tempfile
import time
from datetime import UTC, datetime
from pathlib import Path

#: Where the register is kept, unless the environment names another folder.
HOME, HOME_VARIABLE = "~/.trowel", "TROWEL_HOME"


def shelf_home() -> str:
    return os.path.abspath(os.path.expanduser(os.environ.get(HOME_VARIABLE) or HOME))


def shelf_note(path: str) -> str:
    """Where the shelf is, if that is not where it always is."""
    usual = os.path.abspath(os.path.expanduser(HOME))
    return "" if os.path.dirname(os.path.abspath(path)) == usual else f"the shelf is kept at {path}"


def file_url(path: str) -> str:
    """A file URL, percent-encoded; a path that cannot be one is given back as it is."""
    try:
        return Path(os.path.abspath(path)).as_uri()
    except (OSError, ValueError):
        return path


def map_destination(folder: str, stamp: str | None = None) -> str:
    """A name for a map beside its project, never inside; a second map within one second gets a number."""
    folder = folder.rstrip(os.sep)
    stem = os.path.join(os.path.dirname(folder) or ".", f"{os.path.basename(folder) or 'project'}-map-{stamp or time.strftime('%Y%m%d-%H%M%S')}")
    taken = 1
    while os.path.exists(f"{stem}{'' if taken == 1 else f'-{taken}'}.html"):
        taken += 1
    return f"{stem}{'' if taken == 1 else f'-{taken}'}.html"


def _rows(registry: str) -> list[dict]:
    try:
        found = json.loads(Path(registry).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []


def read_register(registry: str) -> list[dict]:
    """The recorded maps that still exist, newest first; a register that is missing or broken is empty."""
    return sorted((r for r in _rows(registry) if os.path.isfile(str(r.get("map", "")))), key=lambda r: str(r.get("when", "")), reverse=True)


def record_map(registry: str, project: str, path: str, modules: int, folder: str) -> list[dict]:
    """Upserts a map's row by its folder, newest first; rows of maps that are gone are dropped. The file is replaced whole and keeps its mode."""
    own = {"project": project, "map": path, "modules": modules, "when": datetime.now(UTC).isoformat(timespec="microseconds"), "folder": folder}
    kept = [r for r in read_register(registry) if r.get("folder", r.get("project")) not in (folder, project if "folder" not in r else folder)]
    rows = [own, *kept]
    mode = os.stat(registry).st_mode & 0o777 if os.path.exists(registry) else 0o644
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(registry)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2)
    os.chmod(temporary, mode)
    os.replace(temporary, registry)
    return rows


def shelf_page(registry: str) -> str:
    """A page of links to all recorded maps."""
    cells = ["project", "modules", "when"]
    rows = "".join(
        f'<tr><td><a href="{html.escape(file_url(str(r["map"])))}" title="{html.escape(str(r.get("folder", "")))}">{html.escape(str(r.get("project", "?")))}</a></td>' + "".join(f"<td>{html.escape(str(r.get(c, '?')))}</td>" for c in cells[1:]) + "</tr>"
        for r in read_register(registry)
    )
    body = f"<table><tr>{''.join(f'<th>{c}</th>' for c in cells)}</tr>{rows}</table>" if rows else "<p>No map was made yet.</p>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Maps</title><style>body{{font-family:sans-serif;margin:2em}}td,th{{padding:4px 12px;text-align:left}}</style></head><body><h1>Maps</h1>{body}</body></html>'


def write_shelf(registry: str, path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text(shelf_page(registry), encoding="utf-8")
    return path
