"""A folder that keeps saved runs, remembered configurations, consent, key examples and layouts as small JSON files."""

from __future__ import annotations

import json
import re
import time
import uuid
from pathlib import Path

from cotejo.operators.usage import same_configuration

KEPT_EXAMPLES = 200


class Store:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, kind: str, key: str) -> Path:
        (self.folder / kind).mkdir(exist_ok=True)
        return self.folder / kind / f"{re.sub(r'[^A-Za-z0-9_-]', '_', key)}.json"

    def _read(self, kind: str, key: str) -> dict | None:
        try:
            return json.loads(self._path(kind, key).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None

    def _write(self, kind: str, key: str, value: dict) -> None:
        path = self._path(kind, key)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(value, ensure_ascii=False, default=str), encoding="utf-8")
        part.replace(path)

    # saved runs

    def save(self, name: str, config: dict, summary: dict, user: str = "local", files: list[str] = ()) -> str:
        run = uuid.uuid4().hex
        self._write("runs", run, {"id": run, "name": name, "user": user, "at": time.time(), "config": config, "summary": summary, "files": list(files)})
        return run

    def list_runs(self, user: str | None = None) -> list[dict]:
        """Newest first."""
        runs = [r for p in (self.folder / "runs").glob("*.json") if (r := self._read("runs", p.stem))]
        return sorted((r for r in runs if user is None or r["user"] == user), key=lambda r: -r["at"])

    def get(self, run: str) -> dict | None:
        return self._read("runs", run) if re.fullmatch("[0-9a-f]{32}", run) else None

    def delete(self, run: str) -> None:
        if re.fullmatch("[0-9a-f]{32}", run):
            self._path("runs", run).unlink(missing_ok=True)

    # memory by signature

    def remember(self, signature: str, config: dict) -> dict:
        """Counts a use, and a correction if the configuration is another than the remembered one."""
        known = self._read("memory", signature)
        corrected = known is not None and not same_configuration(known["config"], config)
        entry = {"config": config, "used": (known or {}).get("used", 0) + 1, "corrected": (known or {}).get("corrected", 0) + corrected, "at": time.time()}
        self._write("memory", signature, entry)
        return entry

    def memory(self, signature: str) -> dict | None:
        return self._read("memory", signature)

    def confidence(self, signature: str) -> int:
        m = self.memory(signature) or {"used": 0, "corrected": 0}
        return max(0, min(100, round(100 * (m["used"] - m["corrected"] + 1) / (m["used"] + 2))))

    def consent(self, user: str) -> bool:
        return bool((self._read("consent", user) or {}).get("automatic"))

    def set_consent(self, user: str, automatic: bool) -> None:
        self._write("consent", user, {"automatic": automatic})

    # examples of confirmed keys, and layouts

    def add_key_examples(self, user: str, examples: list[dict]) -> None:
        known = (self._read("keys", user) or {"examples": []})["examples"]
        self._write("keys", user, {"examples": [*known, *examples][-KEPT_EXAMPLES:]})

    def key_examples(self, user: str) -> list[dict]:
        return (self._read("keys", user) or {"examples": []})["examples"]

    def save_layout(self, name: str, document: dict) -> None:
        self._write("layouts", name, document)

    def layouts(self) -> dict[str, dict]:
        return {p.stem: d for p in (self.folder / "layouts").glob("*.json") if (d := self._read("layouts", p.stem)) is not None}
