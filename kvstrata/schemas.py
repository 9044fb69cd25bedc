"""Data model: schemas, errors and name rules.

A box (collection) is a log of mutations (key, op, value, seq): op is put or delete, seq a total order. The live
snapshot is the newest mutation of each key, where that is a put. Keys are bytes (or UTF-8 strings) and compare as
unsigned bytes. Absence is None or NULL; errors are ValueError, IntegrityError and CommitConflict.
"""

from __future__ import annotations

import re

PUT, DELETE, CLEAR = "put", "delete", "clear"
#: Change types of events (fixed values).
CHANGE_TYPES = {PUT: 0, DELETE: 1, CLEAR: 2}
LOG_DDL = "key binary, op string, value binary, seq long, gen long"
EVENT_DDL = "collection string, key binary, change_type int, seq long"
FILE_DDL = "file_id string, filename string, mime_type string, total_size long, chunk_size int, chunk_count int, content_hash string"
CHUNK_DDL = "file_id string, index int, data binary, crc32 long"


class IntegrityError(Exception):
    """Stored bytes don't have the checksum that was stored with them."""


class CommitConflict(Exception):
    """Another writer committed the version that this one was about to commit."""


def box_name(name: str) -> str:
    """The name, if it is a safe directory name."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name or "") or set(name) == {"."} or name.startswith("_"):
        raise ValueError(f"not a box name: {name!r}")
    return name


def to_bytes(key: str | bytes) -> bytes:
    return key.encode("utf-8") if isinstance(key, str) else bytes(key)
