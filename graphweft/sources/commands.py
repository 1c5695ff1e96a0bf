"""Commands that are read: a closed list of read-only programs and verbs, each with a time limit, four at a time."""

from __future__ import annotations

import subprocess
import threading
from dataclasses import dataclass, field

#: What may be run, how many at once, and for how long.
GIT_VERBS = frozenset({"rev-parse", "for-each-ref", "worktree", "log", "show", "status", "ls-files", "check-attr", "check-ignore", "cat-file", "rev-list"})
CARGO_VERBS = frozenset({"metadata"})
MOST_AT_ONCE, TIMEOUT, HISTORY_TIMEOUT = 4, 20.0, 120.0


class NotAllowed(ValueError):
    """A command that isn't on the list."""


@dataclass
class Runner:
    """Runs allowed commands on the driver; cancel() ends what runs and what waits."""

    timeout: float = TIMEOUT
    _slots: threading.Semaphore = field(default_factory=lambda: threading.Semaphore(MOST_AT_ONCE))
    _running: set = field(default_factory=set)
    cancelled: bool = False

    def run(self, words: list[str], cwd: str, stdin: bytes | None = None, timeout: float | None = None) -> bytes:
        """Standard output; a failing command raises CalledProcessError."""
        program, verb = words[0], next((w for w in words[1:] if not w.startswith("-")), "")
        if verb not in {"git": GIT_VERBS, "cargo": CARGO_VERBS}.get(program, frozenset()) or (verb == "worktree" and "list" not in words):
            raise NotAllowed(" ".join(words[:2]))
        with self._slots:
            if self.cancelled:
                raise subprocess.CalledProcessError(-1, words)
            child = subprocess.Popen(words, cwd=cwd, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
            self._running.add(child)
            try:
                out, err = child.communicate(stdin, timeout=timeout or self.timeout)
            except subprocess.TimeoutExpired:
                child.kill()
                child.communicate()
                raise
            finally:
                self._running.discard(child)
        if child.returncode:
            raise subprocess.CalledProcessError(child.returncode, words, out, err)
        return out

    def cancel(self) -> None:
        self.cancelled = True
        for child in list(self._running):
            child.kill()
