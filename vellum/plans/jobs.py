"""Registry of capture jobs: what runs, what failed, and what may be tried again. Driver-side bookkeeping only."""

from __future__ import annotations

import threading
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Job:
    job_id: str
    url: str
    state: str = "running"
    error: str | None = None


class Jobs:
    def __init__(self):
        self._jobs: dict[str, Job] = {}
        self._cancelled: set[str] = set()
        self._lock = threading.Lock()

    def start(self, job_id: str, url: str) -> Job:
        with self._lock:
            self._cancelled.discard(job_id)
            self._jobs[job_id] = Job(job_id, url)
            return self._jobs[job_id]

    def done(self, job_id: str) -> None:
        """Finished jobs leave the list."""
        with self._lock:
            self._jobs.pop(job_id, None)

    def failed(self, job_id: str, error: str) -> None:
        """Failed jobs stay until they are tried again or dismissed; cancelled ones leave."""
        with self._lock:
            if job_id in self._cancelled:
                self._jobs.pop(job_id, None)
            elif job_id in self._jobs:
                self._jobs[job_id] = replace(self._jobs[job_id], state="failed", error=error)

    def retry(self, job_id: str) -> Job | None:
        with self._lock:
            job = self._jobs.get(job_id)
            if job is None or job.state != "failed":
                return None
            self._jobs[job_id] = replace(job, state="running", error=None)
            return self._jobs[job_id]

    def dismiss(self, job_id: str) -> bool:
        with self._lock:
            return self._jobs.get(job_id, Job("", "")).state == "failed" and self._jobs.pop(job_id) is not None

    def cancel(self, job_id: str) -> None:
        with self._lock:
            if job_id in self._jobs:
                self._cancelled.add(job_id)

    def cancelled(self, job_id: str) -> bool:
        with self._lock:
            return job_id in self._cancelled

    def all(self) -> list[Job]:
        with self._lock:
            return list(self._jobs.values())
