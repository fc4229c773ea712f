"""A small HTTP service around the jobs: health, queued jobs and their state, and the audit trail, by roles."""

from __future__ import annotations

import json
import queue
import threading
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from cartulary.sources.stores import JobStore, token_fingerprint

# Who may do what.
ENQUEUE, READ, AUDIT = ("admin", "operator"), ("admin", "operator", "viewer"), ("admin",)


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status, self.detail = status, detail


class Jobs:
    """Runs queued jobs one after another in a thread of its own, and keeps their state in the store."""

    def __init__(self, store: JobStore, tasks: dict[str, Callable[[dict], dict]]):
        self.store, self.tasks, self.queued = store, tasks, queue.Queue()
        threading.Thread(target=self._work, daemon=True).start()

    def put(self, kind: str, payload: dict) -> str:
        job = str(uuid.uuid4())
        self.store.create(job, kind, payload)
        self.queued.put((job, kind, payload))
        return job

    def _work(self) -> None:
        while True:
            job, kind, payload = self.queued.get()
            self.store.update(job, "running")
            try:
                self.store.update(job, "finished", self.tasks[kind](payload))
            except Exception as error:  # the state of the job says what failed; the next job runs
                self.store.update(job, "failed", error=str(error))
            self.queued.task_done()


def service(address: tuple[str, int], store: JobStore, tasks: dict[str, Callable[[dict], dict]], tokens: dict[str, dict], check: Callable[[str, dict], str | None] = lambda kind, payload: None) -> ThreadingHTTPServer:
    """A server of ``tasks`` by kind. ``tokens`` gives role and actor; ``check`` says why a job's payload is refused."""
    jobs = Jobs(store, tasks)

    class Handler(BaseHTTPRequestHandler):
        def _allowed(self, roles: tuple, action: str, detail: dict) -> None:
            said = self.headers.get("Authorization", "")
            if not said.lower().startswith("bearer "):
                raise Refused(401, "missing bearer token")
            token = said.split(" ", 1)[1].strip()
            if token not in tokens:
                raise Refused(403, "invalid token")
            role = tokens[token].get("role", "viewer")
            if role.lower() not in roles:
                raise Refused(403, f"role {role!r} not allowed")
            store.log(tokens[token].get("actor", "unknown"), action, detail | {"role": role, "path": self.path, "method": self.command, "token_fp": token_fingerprint(token)})

        def _answer(self, run: Callable[[], dict]) -> None:
            try:
                status, body = 200, run()
            except Refused as refused:
                status, body = refused.status, {"detail": refused.detail}
            except ValueError as error:
                status, body = 422, {"detail": str(error)}
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _get(self) -> dict:
            place = urlsplit(self.path)
            parts = place.path.strip("/").split("/")
            if parts == ["health"]:
                return {"status": "ok", "ts_utc": datetime.now(UTC).isoformat()}
            if parts[:2] == ["v1", "jobs"] and len(parts) == 3:
                self._allowed(READ, "get_job", {"job": parts[2]})
                if (found := store.get(parts[2])) is None:
                    raise Refused(404, "no such job")
                return found
            if parts == ["v1", "audit"]:
                limit = int(parse_qs(place.query).get("limit", ["100"])[0])
                self._allowed(AUDIT, "list_audit", {"limit": limit})
                return {"items": [dict(zip(("id", "actor", "action", "detail"), row)) for row in store.last(limit)]}
            raise Refused(404, "no such path")

        def _post(self) -> dict:
            parts = urlsplit(self.path).path.strip("/").split("/")
            payload = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            if parts[:2] != ["v1", "jobs"] or len(parts) != 3 or parts[2] not in tasks:
                raise Refused(404, "no such path")
            self._allowed(ENQUEUE, f"enqueue_{parts[2]}", {"payload": payload})
            if not isinstance(payload, dict) or (why := check(parts[2], payload)):
                raise Refused(400, why if isinstance(payload, dict) else "the payload is no object")
            return {"job_id": jobs.put(parts[2], payload), "status": "queued"}

        def do_GET(self) -> None:
            self._answer(self._get)

        def do_POST(self) -> None:
            self._answer(self._post)

        def log_message(self, *args) -> None:
            """The audit trail says who did what."""

    return ThreadingHTTPServer(address, Handler)
