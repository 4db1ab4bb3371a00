"""Intermediate tables of this package's operators."""

from plumbline.store import release, release_part, shared_dir, stored

__all__ = ["release", "release_part", "shared_dir", "stored"]
