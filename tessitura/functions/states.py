"""States of a job."""

from __future__ import annotations

#: Neither done nor failed; those that a listing shows as pending; those that are over.
ACTIVE = ("pending", "queued", "running")
PENDING = ("queued", "running")
TERMINAL = ("done", "error", "cancelled")
