"""Source files of a project, and what kind of project it is."""

from __future__ import annotations

import contextlib
import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

EXTENSIONS = {"rust": ("rs",), "typescript": ("ts", "tsx", "js", "jsx"), "python": ("py", "pyi"), "go": ("go",)}
#: Folders that hold no Python source of the project.
NOT_PYTHON = frozenset("__pycache__ .venv venv .tox build dist .eggs node_modules".split())
MARKS = {"rust": ("Cargo.toml",), "go": ("go.mod",), "typescript": ("tsconfig.json", "package.json"), "python": ("pyproject.toml", "setup.py", "setup.cfg")}


def walk(root: str) -> list[str]:
    """Paths of all files under a root, relative to it; what git ignores is left out, and .git."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True)
    if done.returncode == 0:
        found = [p for p in done.stdout.decode(errors="surrogateescape").split("\0") if p]
        return sorted(p for p in set(found) if os.path.isfile(os.path.join(root, p)))
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, dirs, names in os.walk(root) for f in names if ".git" not in Path(os.path.relpath(d, root)).parts)


def language_of(path: str) -> str | None:
    ext = path.rpartition(".")[2] if "." in path else ""
    return next((k for k, v in EXTENSIONS.items() if ext in v), None)


def is_source_path(path: str) -> bool:
    return language_of(path) is not None


def rust_crates(root: str) -> dict[str, str]:
    """Names of Cargo packages by folder."""
    found = {}
    for p in walk(root):
        if p.rpartition("/")[2] == "Cargo.toml":
            with open(os.path.join(root, p), "rb") as f, contextlib.suppress(tomllib.TOMLDecodeError):
                name = (tomllib.load(f).get("package") or {}).get("name")
                if name:
                    found[p.rpartition("/")[0]] = name
    return found


def is_generated_go(path: str, content: str) -> bool:
    head = content.split("\npackage ", 1)[0]
    return path.endswith((".pb.go", "_gen.go")) or any(line.startswith("// Code generated ") and line.rstrip().endswith("DO NOT EDIT.") for line in head.splitlines())


def sources(root: str, lang: str) -> list[str]:
    """Files of a language; hidden ones are left out, and folders of tools for Python, tests for Go."""
    out = []
    for p in walk(root):
        parts = p.split("/")
        if language_of(p) != lang or lang in ("python", "typescript") and any(x.startswith(".") for x in parts):
            continue
        if lang == "python" and NOT_PYTHON & set(parts[:-1]) or lang == "go" and p.endswith("_test.go"):
            continue
        out.append(p)
    return out


def has_language(root: str, lang: str) -> bool:
    """By the project's own files; for TypeScript and Python also by a source in the upper three levels."""
    if any(os.path.exists(os.path.join(root, m)) for m in MARKS[lang]):
        return True
    if lang not in ("typescript", "python"):
        return False
    return any(language_of(p) == lang for p in walk(root) if p.count("/") < 3 and not any(x.startswith(".") for x in p.split("/")))


def read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, content) of the files under a root."""
    if not paths:
        return spark.createDataFrame([], "path string, content string")
    base = Path(root).resolve().as_uri()
    found = spark.read.format("binaryFile").load([f"{base}/{p}" for p in paths])
    name = F.substr(F.regexp_replace("path", "^file:/+", "/"), F.lit(len(str(Path(root).resolve())) + 2))
    return found.select(name.alias("path"), F.decode("content", "utf-8").alias("content"))


def project_root(start: str, folder: str, explicit: str | None = None) -> str:
    """The highest folder above that holds both the tool's folder and .git; else the start."""
    if explicit:
        return str(Path(explicit).resolve())
    here = Path(start).resolve()
    return str(next((p for p in reversed([here, *here.parents]) if (p / folder).exists() and (p / ".git").exists()), here))


def classify_target(target: str, root: str) -> tuple[str, str]:
    """(path, its name) for what exists, else (symbol, target)."""
    p = Path(root, target)
    return ("path", str(p.resolve().relative_to(Path(root).resolve()))) if p.exists() else ("symbol", target)


def folder_below(folder: str, root: str) -> str:
    """A folder relative to the root, both without links; empty for the root itself."""
    p = Path(root, folder).resolve()
    if not p.is_dir():
        raise ValueError(f"no folder {folder!r}")
    found = str(p.relative_to(Path(root).resolve()))
    return "" if found == "." else found
