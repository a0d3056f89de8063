"""Writers: stable JSON, run folders with a manifest, create-only installs."""

from __future__ import annotations

import ctypes
import errno
import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row

from arbiter.errors import DataValidationError


def plain(value: Any) -> Any:
    """Rows, arrays and maps as what json writes."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    return value


def stable_json(value: Any) -> bytes:
    """Sorted keys, two spaces, UTF-8, a line feed at the end."""
    return (json.dumps(plain(value), indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n").encode()


def write_json(path: str | Path, value: Any, replace: bool = True) -> None:
    """Written beside the target and moved there, so readers see a whole file or none."""
    path = Path(path)
    if path.exists() and not replace:
        raise DataValidationError(f"{path} exists")
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(stable_json(value))
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def jsonl(rows: DataFrame, *order: str) -> Iterator[bytes]:
    """Canonical lines of a result, read to the driver part by part."""
    for r in (rows.orderBy(*order) if order else rows).toLocalIterator():
        yield (json.dumps(plain(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()


def affinity_lines(scores: DataFrame, digits: int | None = None) -> Iterator[bytes]:
    yield b"document_id,expert_id,score\n"
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x
    for r in scores.orderBy("document_id", "expert_id").toLocalIterator():
        yield f"{quoted(r.document_id)},{quoted(r.expert_id)},{r.score if digits is None else f'{r.score:.{digits}f}'}\n".encode()


#: renameat2's flag that never replaces, and the name of the folder that paths are relative to. Fixed values.
_NOREPLACE, _AT_FDCWD = 1, -100


def move_new(source: Path, target: Path) -> None:
    """Move in one step; a target that is there, even an empty folder made a moment before, is never replaced."""
    libc = ctypes.CDLL(None, use_errno=True)
    if hasattr(libc, "renameat2"):
        if libc.renameat2(_AT_FDCWD, os.fsencode(source), _AT_FDCWD, os.fsencode(target), _NOREPLACE) == 0:
            return
        code = ctypes.get_errno()
        if code == errno.EEXIST:
            raise DataValidationError(f"{target} exists")
        if code not in (errno.EINVAL, errno.ENOSYS):  # else: the file system can't say so
            raise OSError(code, os.strerror(code), str(target))
    # Whoever makes the target's own lock first may move.
    lock = target.parent / f".{target.name}.lock"
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError as error:
        raise DataValidationError(f"{target} is being written") from error
    try:
        if target.exists():
            raise DataValidationError(f"{target} exists")
        os.rename(source, target)
    finally:
        lock.unlink()


def write_run(folder: str | Path, files: Mapping[str, bytes | Iterable[bytes]], manifest: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A run folder with its files and a manifest of their sizes and digests. It appears whole, and never replaces one."""
    folder = Path(folder)
    if folder.exists():
        raise DataValidationError(f"{folder} exists")
    stage = Path(tempfile.mkdtemp(dir=folder.parent, prefix=f".{folder.name}."))
    try:
        found: dict[str, Any] = {}
        for name, content in files.items():
            digest, size = hashlib.sha256(), 0
            with (stage / name).open("wb") as f:
                for part in [content] if isinstance(content, bytes) else content:
                    f.write(part)
                    digest.update(part)
                    size += len(part)
            found[name] = {"bytes": size, "sha256": digest.hexdigest()}
        record = {**(manifest or {}), "files": found}
        (stage / "manifest.json").write_bytes(stable_json(record))
        move_new(stage, folder)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return record


def verify_run(folder: str | Path) -> dict[str, Any]:
    """The manifest, after every file's digest was compared."""
    record = json.loads((Path(folder) / "manifest.json").read_bytes())
    for name, want in record["files"].items():
        data = (Path(folder) / name).read_bytes()
        if len(data) != want["bytes"] or hashlib.sha256(data).hexdigest() != want["sha256"]:
            raise DataValidationError(f"{name} isn't what its manifest says")
    return record


class Captured:
    """Input files as they were when a run began: taken once, and compared before anything is published."""

    def __init__(self, adapter: str, limits: Mapping[str, int], **paths: str | Path):
        self.adapter, self.limits, self.paths = adapter, dict(limits), {k: Path(v) for k, v in paths.items()}
        self.content = {k: self._read(k) for k in self.paths}

    def _read(self, name: str) -> bytes:
        data = self.paths[name].read_bytes()
        if name in self.limits and len(data) > self.limits[name]:
            raise DataValidationError(f"{name} has more than {self.limits[name]} bytes")
        return data

    def record(self) -> dict[str, Any]:
        """What a manifest keeps: the adapter with its limits, and each input's size and digest."""
        return {"adapter": self.adapter, "limits": self.limits, "inputs": {k: {"bytes": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in self.content.items()}}

    def verify(self) -> None:
        if changed := [k for k in self.paths if self._read(k) != self.content[k]]:
            raise DataValidationError(f"inputs have changed since they were read: {', '.join(changed)}")

    @staticmethod
    def same_contract(one: Mapping[str, Any], other: Mapping[str, Any]) -> None:
        """Two runs' records must name one adapter with the same limits and the same inputs."""
        for name in ("adapter", "limits", "inputs"):
            if one.get(name) != other.get(name):
                raise DataValidationError(f"the runs differ in their {name}")


def write_table(rows: DataFrame, path: str) -> None:
    """The distributed form for results of any size."""
    rows.write.mode("errorifexists").parquet(path)
