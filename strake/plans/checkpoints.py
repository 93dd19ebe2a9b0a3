"""Job checkpoints: small JSON documents, written whole or not at all, on any file system."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyarrow import fs

from ..sources.shared import located

PHASES = ("INITIALIZING", "SAMPLING", "WAITING_FOR_PARTITIONS", "SORTING", "SHUFFLING", "MERGING", "COMPLETED")
FAILED = "FAILED"


def next_phase(phase: str) -> str:
    """The phase after one; failed if there is none."""
    return PHASES[PHASES.index(phase) + 1] if phase in PHASES[:-1] else FAILED


def may_follow(old: str, new: str) -> bool:
    """Whether a job may go from one phase to another: to the next, to failed, or from failed to the beginning."""
    if new == FAILED:
        return True
    return new == PHASES[0] if old == FAILED else old in PHASES and new == next_phase(old)


def on_error(phase: str, failed: int, workers: int) -> str:
    """What to do about errors: early phases go on while most workers do, late ones are tried again."""
    if phase in ("SAMPLING", "SORTING"):
        return "continue" if workers - failed > workers / 2 else "abort"
    return "retry" if phase in ("SHUFFLING", "MERGING") else "abort"


@dataclass
class State:
    """What a job knows of itself: its input, where it parts it, which partitions are written, and anything else worth saying."""

    inputs: list[str] = field(default_factory=list)
    boundaries: list[str] = field(default_factory=list)  # hex
    shuffle_map: dict[int, int] = field(default_factory=dict)
    outputs: list[int] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)


class Phases:
    """The phase of a job, which only goes where it may."""

    def __init__(self):
        self.now: str | None = None

    def enter(self, phase: str) -> str:
        if self.now is None and phase not in (PHASES[0], FAILED) or self.now is not None and not may_follow(self.now, phase):
            raise ValueError(f"a job does not go from {self.now} to {phase}")
        self.now = phase
        return phase


class Checkpoints:
    """The checkpoints of one job, in a folder of its own."""

    def __init__(self, job: str, folder: str):
        self.job, self.folder = job, f"{folder.rstrip('/')}/{job}"
        self.system, self.inner = located(self.folder)
        self.system.create_dir(self.inner, recursive=True)

    def _files(self) -> list[fs.FileInfo]:
        """Newest first."""
        found = [f for f in self.system.get_file_info(fs.FileSelector(self.inner)) if f.type == fs.FileType.File and f.base_name.endswith(".json")]
        return sorted(found, key=lambda f: (f.mtime_ns or 0, f.path), reverse=True)

    def save(self, phase: str, state: State, progress: float) -> str:
        name = f"checkpoint_{time.time_ns() // 1_000_000}_{phase}"
        body = {"id": name, "job": self.job, "phase": phase, "timestamp": time.time(), "progress": progress, "state": asdict(state)}
        part = f"{self.inner}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps(body, indent=2).encode())
        self.system.move(part, f"{self.inner}/{name}.json")
        return name

    def _read(self, path: str) -> dict | None:
        try:
            with self.system.open_input_stream(path) as f:
                body = json.loads(f.read())
            ok = body["id"] == path.rsplit("/", 1)[1].removesuffix(".json") and body["job"] == self.job and 0 <= body["progress"] <= 1
        except (OSError, ValueError, KeyError, TypeError):
            return None
        return body if ok else None

    def valid(self, name: str) -> bool:
        return self._read(f"{self.inner}/{name}.json") is not None

    def latest(self) -> dict | None:
        """The newest valid one; an invalid one does not hide those before it."""
        return next((c for f in self._files() if (c := self._read(f.path))), None)

    def keep(self, last: int = 3) -> None:
        for f in self._files()[last:]:
            self.system.delete_file(f.path)

    def drop_older(self, seconds: float = 60) -> None:
        """Deletes those over an age, and those that cannot be read."""
        for f in self._files():
            body = self._read(f.path)
            if body is None or time.time() - body["timestamp"] > seconds:
                self.system.delete_file(f.path)

    def drop_all(self) -> None:
        for f in self._files():
            self.system.delete_file(f.path)

    def statistics(self) -> tuple[int, int]:
        """How many, and their bytes."""
        found = self._files()
        return len(found), sum(f.size for f in found)


def restored(body: dict) -> State:
    """The state of a checkpoint; JSON's text keys are numbers again."""
    state = State(**body["state"])
    state.shuffle_map = {int(k): v for k, v in state.shuffle_map.items()}
    return state
