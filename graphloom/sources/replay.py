"""A transport that answers from landed files instead of the network: replay:<folder>?.. for a feed, replay:<folder>/objects?.. for a collection.

The folder, on a path that every worker can open, holds the folder listing: text files part-*, one JSON item in a line, in the order of
their names. Answers have the services' paging. A request reads the files that its page lies in: lines are counted once for a process,
and the file read last is kept, so that a listing read page by page is read once.
"""

from __future__ import annotations

import glob
import json
import os
import urllib.parse
from bisect import bisect_right
from functools import lru_cache


@lru_cache(maxsize=2)
def _files(folder: str, changed: int) -> tuple[list[str], list[int]]:
    """Files, and the number of items up to the end of each; changed is the time of the folder's last change."""
    files, ends = sorted(glob.glob(f"{glob.escape(folder)}/part-*")), [0]
    for name in files:
        with open(name, "rb") as file:
            ends.append(ends[-1] + sum(1 for _ in file))
    return files, ends


@lru_cache(maxsize=1)
def _items(name: str, changed: int) -> list[bytes]:
    with open(name, "rb") as file:
        return file.read().splitlines()


def _page(folder: str, start: int, size: int) -> tuple[int, bytes]:
    """(items in all, the asked ones as a JSON list)."""
    changed = os.stat(folder).st_mtime_ns
    files, ends = _files(folder, changed)
    found: list[bytes] = []
    end = min(start + size, ends[-1])
    while start < end:
        i = bisect_right(ends, start) - 1
        found += _items(files[i], changed)[start - ends[i] : end - ends[i]]
        start = min(end, ends[i + 1])
    return ends[-1], b"[" + b",".join(found) + b"]"


def get(url: str, headers: dict[str, str] | None = None) -> bytes:
    """The page that the url's query asks for; headers are not looked at."""
    path, _, query = url.removeprefix("replay:").partition("?")
    asked = dict(urllib.parse.parse_qsl(query))
    folder = os.path.join(path.removesuffix("/objects").removeprefix("file:"), "listing")
    if path.endswith("/objects"):
        start, size = int(asked.get("next", 0)), int(asked.get("limit", 5_000))
        total, items = _page(folder, start, size)
        more = start + size < total
        rest = {"more": more, **({"next": str(start + size)} if more else {})}
        return b'{"objects": ' + items + b", " + json.dumps(rest)[1:].encode()
    total, items = _page(folder, int(asked["startIndex"]), int(asked["resultsPerPage"]))
    return b'{"totalResults": %d, "vulnerabilities": ' % total + items + b"}"
