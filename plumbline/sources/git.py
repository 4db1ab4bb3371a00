"""State of a working copy: what a check is about, and its changes."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import diff
from .files import is_source_path
from plumbline.operators.scope import union_changes


def git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout if done.returncode == 0 else None


@dataclass(frozen=True)
class State:
    """mode: uncommitted, branch-diff or whole-project; base: what a branch is held against."""

    mode: str
    base: str | None = None
    against: str | None = None


def base_branch(root: str) -> str | None:
    return next((b for b in ("main", "master") if git(root, "rev-parse", "--verify", "--quiet", b) is not None), None)


def untracked(root: str) -> list[str]:
    return [p for p in (git(root, "ls-files", "--others", "--exclude-standard", "-z") or "").split("\0") if p]


def is_dirty(paths: list[str]) -> bool:
    return any(map(is_source_path, paths))


def working_state(root: str) -> State:
    """Uncommitted changes of sources come first; a clean base branch is checked whole, another one from where it left."""
    changed = [p for p in (git(root, "diff", "--name-only", "-z", "HEAD") or "").split("\0") if p]
    if is_dirty([*changed, *untracked(root)]):
        return State("uncommitted", None, "HEAD")
    base = base_branch(root)
    here = (git(root, "rev-parse", "--abbrev-ref", "HEAD") or "").strip()
    if base is None or here == base:
        return State("whole-project")
    return State("branch-diff", base, (git(root, "merge-base", base, "HEAD") or base).strip())


def changes(spark: SparkSession, root: str, state: State) -> DataFrame:
    text = git(root, "diff", "-U0", "--no-color", state.against or "HEAD") or ""
    ranges = diff.parse(spark.createDataFrame([("git", text)], "input string, content string"))
    new = untracked(root) if state.mode == "uncommitted" else []
    return union_changes(ranges, spark.createDataFrame([(p,) for p in new], "file string"))
