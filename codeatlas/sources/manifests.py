"""Dependencies from manifests: small files, parsed by one function each inside mapInPandas."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEPENDENCIES = "repo string, name string, version string, path string, features string, repository_url string"


def cargo_toml(text: str) -> list[dict]:
    """[dependencies] of a manifest; a workspace's members inherit by `workspace = true`."""
    return [_entry(k, v) for k, v in tomllib.loads(text).get("dependencies", {}).items()]


def _entry(name: str, value: object, inherited: dict | None = None) -> dict:
    if isinstance(value, str):
        return {"name": name, "version": value}
    value = dict(value)
    features = list(value.get("features", []))
    if value.get("workspace") and inherited is not None:
        base = inherited.get(name, {})
        base = {"version": base} if isinstance(base, str) else base
        features = [*base.get("features", []), *(f for f in features if f not in base.get("features", []))]
        value = base | value
    return {"name": name, "version": value.get("version", "*"), "path": value.get("path"), "features": ",".join(features) or None}


def workspace_members(root: str, members: dict[str, str]) -> list[dict]:
    """Dependencies of workspace members (path -> manifest text) with the workspace's own filled in."""
    inherited = tomllib.loads(root).get("workspace", {}).get("dependencies", {})
    return [_entry(k, v, inherited) | {"member": m} for m, text in members.items() for k, v in tomllib.loads(text).get("dependencies", {}).items()]


def cargo_lock(text: str) -> list[dict]:
    out = []
    for p in tomllib.loads(text).get("package", []):
        source = p.get("source", "")
        url = source.removeprefix("git+").split("?")[0].split("#")[0] if source.startswith("git+") else None
        out.append({"name": p["name"], "version": p["version"], "repository_url": url})
    return out


def package_json(text: str) -> list[dict]:
    data = json.loads(text)
    return [{"name": k, "version": v} for part in ("dependencies", "devDependencies") for k, v in data.get(part, {}).items()]


_SPEC = re.compile(r"^\s*([^><=!~\[; ]+)\s*(?:\[[^\]]*\])?\s*([^;]*)")


def requirement(spec: str) -> dict:
    """Name and version of a PEP 508 line; extras and markers are dropped."""
    m = _SPEC.match(spec)
    return {"name": m[1], "version": m[2].strip() or "*"} if m else {"name": spec.strip(), "version": "*"}


def pyproject(text: str) -> list[dict]:
    data = tomllib.loads(text)
    project = data.get("project", {})
    out = [requirement(s) for s in project.get("dependencies", [])]
    out += [requirement(s) for group in project.get("optional-dependencies", {}).values() for s in group]
    poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return out + [_entry(k, v) for k, v in poetry.items() if k != "python"]


def requirements_txt(text: str) -> list[dict]:
    lines = (x.split("#")[0].strip() for x in text.splitlines())
    return [requirement(x) for x in lines if x and not x.startswith("-")]


def tsconfig(text: str) -> dict:
    """baseUrl and paths; comments and trailing commas are allowed."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    return {"baseUrl": options.get("baseUrl", "."), "paths": options.get("paths", {})}


def npm_members(package: str, folders: list[str]) -> list[str]:
    """Which folders are workspace members of a package.json: patterns of one level, `dir/*` or `dir`."""
    spaces = json.loads(package).get("workspaces", [])
    patterns = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    shapes = [re.compile("[^/]+".join(map(re.escape, p.removeprefix("./").rstrip("/").split("*")))) for p in patterns]
    return [f for f in sorted(folders) if any(x.fullmatch(f) for x in shapes)]


def registry(text: str) -> list[dict]:
    """Registered repositories of a TOML file: name, path, git_remote, git_common_dir, last_indexed."""
    keys = ("name", "path", "git_remote", "git_common_dir", "last_indexed")
    return [{k: None if r.get(k) is None else str(r[k]) for k in keys} for r in tomllib.loads(text).get("repos", [])]


READERS: dict[str, Callable[[str], list[dict]]] = {"Cargo.toml": cargo_toml, "Cargo.lock": cargo_lock, "package.json": package_json, "pyproject.toml": pyproject, "requirements.txt": requirements_txt}


def dependencies(manifests: DataFrame) -> DataFrame:
    """Dependencies of (repo, path, content) manifest files; a file that can't be read gives no rows."""
    names = [c.split()[0] for c in DEPENDENCIES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, content in zip(b["repo"], b["path"], b["content"], strict=True):
                reader = READERS.get(path.rpartition("/")[2])
                try:
                    rows += [{"repo": repo} | d for d in (reader(content) if reader else [])]
                except (ValueError, tomllib.TOMLDecodeError):
                    continue
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return manifests.select("repo", "path", "content").mapInPandas(run, DEPENDENCIES)
