"""Runs: a locked workspace that ends sealed, numbered checkpoints, checks of sealed dependencies, a registry of stages."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import platform
import re
import stat
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from types import TracebackType

from pairscope.sources.tables import file_digest, write_json_once

# Parts of configuration keys that look like secrets.
SECRET_PARTS = ("api_key", "password", "secret", "token")
# Folders of a run. The manifests in it are 000_start, 001_environment and 999_end; the lock is .run-lock.
FOLDERS = ("artifacts", "checkpoints", "logs", "manifests", "metrics", "tables")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


_SECRET = re.compile("|".join(SECRET_PARTS), re.IGNORECASE)


def _named(value: object, at: str) -> Iterator[str]:
    """Dotted paths of all keys of a configuration."""
    if isinstance(value, dict):
        for k, x in value.items():
            yield f"{at}.{k}"
            yield from _named(x, f"{at}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, x in enumerate(value):
            yield from _named(x, f"{at}[{i}]")


def refuse_secrets(value: object, at: str = "config") -> None:
    """Raise if any key, at any depth, looks like a secret; the message lists the paths and no value."""
    if bad := [path for path in _named(value, at) if _SECRET.search(path.rsplit(".", 1)[-1])]:
        raise ValueError(f"these keys look like secrets: {bad}")


def check_runtime(config: dict) -> None:
    """Shard size must be positive, resume on, and texts never logged."""
    runtime = config.get("runtime", {})
    if int(runtime.get("shard_size", 500)) < 1:
        raise ValueError("shard_size must be positive")
    if not runtime.get("resume", True):
        raise ValueError("resume must be on")
    if runtime.get("log_text", False):
        raise ValueError("texts must not be logged")


def environment() -> dict:
    """Interpreter, platform and digest of this package's sources."""
    root = Path(__file__).resolve().parents[1]
    h = hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        h.update(p.relative_to(root).as_posix().encode() + b"\0" + p.read_bytes())
    return {"python": sys.version.split()[0], "platform": platform.platform(), "source_sha256": h.hexdigest()}


def describe_error(error: BaseException) -> dict:
    """Type and digest of an error; its message may hold text and is not kept."""
    return {"type": type(error).__name__, "message_sha256": hashlib.sha256(str(error).encode()).hexdigest()}


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = getattr(record, "fields", {})
        return json.dumps({"at": now(), "level": record.levelname, "event": record.getMessage(), **extra}, sort_keys=True)


@dataclass
class Checkpoints:
    """Append-only numbered events."""

    folder: Path
    count: int = 0

    def write(self, event: str, details: dict | None = None) -> Path:
        path = self.folder / f"{self.count:06d}_{event}.json"
        write_json_once(path, {"event": event, "at": now(), "details": details or {}})
        self.count += 1
        return path


@dataclass
class RunWorkspace:
    """``with RunWorkspace(root, stage, config) as run``: one directory used once.

    On entry: exclusive lock, folders, start and environment manifests. On a clean exit: end manifest and a seal with the digest of every
    file, then all files become read-only. On an error: end manifest with its type and digest, no seal. The
    seal is written last, so an unsealed run is an unfinished one also where links are not atomic.
    """

    root: Path
    stage: str
    config: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = Path(self.root)

    def __enter__(self) -> RunWorkspace:
        refuse_secrets(self.config)
        check_runtime(self.config)
        self.root.mkdir(parents=True, exist_ok=True)
        with open(self.root / ".run-lock", "x") as f:
            f.write(f"{os.getpid()}\n")
        for name in FOLDERS:
            (self.root / name).mkdir()
        self.checkpoints = Checkpoints(self.root / "checkpoints")
        self.log = logging.getLogger(f"pairscope.run.{self.root.name}.{id(self)}")
        self.log.propagate = False
        self.log.setLevel(logging.INFO)
        self._handler = logging.FileHandler(self.root / "logs" / "run.jsonl")
        self._handler.setFormatter(_JsonLines())
        self.log.addHandler(self._handler)
        write_json_once(self.root / "artifacts" / "config.json", self.config)
        write_json_once(self.root / "manifests" / "000_start.json", {"status": "started", "stage": self.stage, "at": now()})
        write_json_once(self.root / "manifests" / "001_environment.json", environment())
        self.checkpoints.write("run_started", {"stage": self.stage})
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        end = {"stage": self.stage, "at": now(), "status": "failed" if error else "completed"}
        if error:
            end["error"] = describe_error(error)
        self.checkpoints.write("run_failed" if error else "run_completed")
        write_json_once(self.root / "manifests" / "999_end.json", end)
        self.log.removeHandler(self._handler)
        self._handler.close()
        (self.root / ".run-lock").unlink()
        if not error:
            files = {p.relative_to(self.root).as_posix(): file_digest(p) for p in sorted(self.root.rglob("*")) if p.is_file()}
            write_json_once(self.root / "seal.json", {"stage": self.stage, "files": files})
            for p in self.root.rglob("*"):
                if p.is_file():
                    p.chmod(stat.S_IRUSR | stat.S_IRGRP)


def verify_sealed(root: str | Path, stage: str, allowed: list[str | Path]) -> dict[str, str]:
    """Digests of a sealed upstream run after checking place, status, stage and every byte; no links, nothing outside the run."""
    root = Path(root)
    if root.is_symlink() or not any(root.resolve(strict=True).is_relative_to(Path(a).resolve()) for a in allowed):
        raise ValueError(f"{root} is outside the allowed roots")
    end = json.loads((root / "manifests" / "999_end.json").read_text())
    if end.get("status") != "completed" or end.get("stage") != stage:
        raise ValueError(f"{root} is no completed {stage} run")
    files = json.loads((root / "seal.json").read_text())["files"]
    if not {"manifests/000_start.json", "manifests/999_end.json", "artifacts/config.json"} <= set(files):
        raise ValueError("the seal is incomplete")
    for name, digest in files.items():
        p = root / name
        if p.is_symlink() or not p.resolve(strict=True).is_relative_to(root.resolve()) or file_digest(p) != digest:
            raise ValueError(f"{name} does not match the seal")
    return files


@dataclass
class StageRegistry:
    """Stages by name, with what they need."""

    stages: dict[str, tuple[Callable[[RunWorkspace, dict[str, Path]], dict], tuple[str, ...]]] = field(default_factory=dict)

    def register(self, name: str, needs: tuple[str, ...] = ()) -> Callable:
        def put(f: Callable) -> Callable:
            if name in self.stages:
                raise ValueError(f"stage {name} is registered already")
            self.stages[name] = (f, needs)
            return f

        return put

    def run(self, name: str, root: str | Path, config: dict, upstream: dict[str, Path] | None = None, allowed: list[str | Path] = (), execute: bool = True) -> dict:
        """Check the sealed dependencies, then run the stage in a workspace of its own."""
        stage, needs = self.stages[name]
        upstream = upstream or {}
        if missing := set(needs) - set(upstream):
            raise ValueError(f"{name} needs {sorted(missing)}")
        with RunWorkspace(Path(root), name, config) as run:
            if not execute:
                run.checkpoints.write("execution_disabled")
                return {}
            for need in needs:
                verify_sealed(upstream[need], need, list(allowed))
            result = stage(run, upstream)
            write_json_once(run.root / "metrics" / "result.json", result)
            return result
