"""Folders of an analysis: one current pass, earlier ones archived, closed ones merged into a running summary."""

from __future__ import annotations

import json
import shutil
import time
from pathlib import Path


class Session:
    """Documents of one analysis under root/name. Plain files for people; data belong in tables.

    The pointer file in root names the current analysis. Names and paths may not leave the folder.
    """

    PASSES = 3

    def __init__(self, root: str):
        self.root = Path(root)

    # --- which -----------------------------------------------------------------------------

    def new(self, name: str, force: bool = False) -> Path:
        """Makes a folder with an open state and points to it; an existing one only with force."""
        folder = self._inside(self.root, name)
        if folder.exists() and not force:
            raise FileExistsError(name)
        folder.mkdir(parents=True, exist_ok=True)
        self._save(folder, {"name": name, "status": "open", "passes": 1, "skipped": [], "started": self._now()})
        (self.root / ".current").write_text(name)
        return folder

    def current(self) -> str | None:
        pointer = self.root / ".current"
        return pointer.read_text().strip() or None if pointer.exists() else None

    def resume(self, name: str) -> dict:
        state = self.status(name)
        (self.root / ".current").write_text(name)
        return state

    def status(self, name: str | None = None) -> dict:
        return json.loads((self._folder(name) / "state.json").read_text())

    def names(self) -> list[str]:
        return sorted(p.parent.name for p in self.root.glob("*/state.json"))

    # --- documents -------------------------------------------------------------------------

    def path(self, document: str, name: str | None = None) -> Path:
        return self._inside(self._folder(name), document)

    def write(self, document: str, text: str, name: str | None = None) -> Path:
        """Replaces a document; a reader sees the old text or the new one, never a part."""
        target = self.path(document, name)
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.part")
        part.write_text(text)
        part.replace(target)
        return target

    def read(self, document: str, name: str | None = None) -> str:
        return self.path(document, name).read_text()

    def skip(self, phase: str, reason: str, name: str | None = None) -> dict:
        """Notes that a phase was left out, and why; a reason is needed."""
        if not reason.strip():
            raise ValueError("a phase is skipped for a reason")
        state = self.status(name)
        state["skipped"].append({"phase": phase, "reason": reason, "at": self._now()})
        self._save(self._folder(name), state)
        return state

    # --- end and beginning -----------------------------------------------------------------

    def close(self, findings: str, name: str | None = None) -> Path:
        """Closes the analysis and puts its findings on top of the summary of all."""
        folder = self._folder(name)
        state = self.status(name) | {"status": "closed", "closed": self._now()}
        self._save(folder, state)
        summary = self.root / "summary.md"
        old = summary.read_text() if summary.exists() else ""
        summary.write_text(f"## {state['name']} ({state['closed']})\n\n{findings.strip()}\n\n{old}".rstrip() + "\n")
        return summary

    def reopen(self, name: str) -> dict:
        """Starts another pass of a closed analysis and archives the documents of the last; PASSES at most."""
        folder, state = self._folder(name), self.status(name)
        if state["status"] != "closed":
            raise ValueError(f"{name} is {state['status']}")
        if state["passes"] >= self.PASSES:
            raise ValueError(f"{name} has had {self.PASSES} passes")
        archive = folder / f"pass_{state['passes']}"
        archive.mkdir()
        for p in folder.iterdir():
            if p != archive and p.name != "state.json" and not p.name.startswith("pass_"):
                shutil.move(str(p), archive / p.name)
        state |= {"status": "open", "passes": state["passes"] + 1}
        self._save(folder, state)
        (self.root / ".current").write_text(name)
        return state

    # --- files -----------------------------------------------------------------------------

    def _folder(self, name: str | None) -> Path:
        name = name or self.current()
        if not name:
            raise FileNotFoundError("no current analysis")
        return self._inside(self.root, name)

    @staticmethod
    def _inside(folder: Path, name: str) -> Path:
        target = (folder / name).resolve()
        if target == folder.resolve() or not target.is_relative_to(folder.resolve()):
            raise ValueError(f"outside of its folder: {name}")
        return target

    @staticmethod
    def _save(folder: Path, state: dict) -> None:
        part = folder / ".state.part"
        part.write_text(json.dumps(state, indent=1))
        part.replace(folder / "state.json")

    @staticmethod
    def _now() -> str:
        return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
