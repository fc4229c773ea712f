"""Small stores outside Spark: conditional downloads, jobs and audit, artifacts, sheets, a timed cache."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import shutil
import sqlite3
import threading
import time
import urllib.error
import urllib.request
import zipfile
from collections import OrderedDict
from collections.abc import Iterable
from contextlib import closing
from datetime import UTC, datetime
from pathlib import Path
from xml.sax.saxutils import escape


def download(url: str, target: Path, timeout: float = 30, opener=urllib.request.urlopen) -> str:
    """Fetches a file unless it is unchanged by ETag or date: ``downloaded`` or ``not_modified``."""
    notes = target.with_suffix(target.suffix + ".http.json")
    known = json.loads(notes.read_text()) if notes.exists() and target.exists() else {}
    headers = {h: known[k] for h, k in (("If-None-Match", "ETag"), ("If-Modified-Since", "Last-Modified")) if known.get(k)}
    try:
        with opener(urllib.request.Request(url, headers=headers), timeout=timeout) as response:
            part = target.with_name(target.name + ".part")
            part.write_bytes(response.read())
            os.replace(part, target)
            notes.write_text(json.dumps({k: response.headers.get(k) for k in ("ETag", "Last-Modified")}))
            return "downloaded"
    except urllib.error.HTTPError as error:
        if error.code == 304 and target.exists():
            return "not_modified"
        raise


class JobStore:
    """Jobs (queued, running, finished, failed) and an audit trail."""

    STATES = ("queued", "running", "finished", "failed")

    def __init__(self, path: str):
        self.db, self.lock = sqlite3.connect(path, check_same_thread=False), threading.RLock()  # one statement at a time
        self.db.execute("CREATE TABLE IF NOT EXISTS jobs (id TEXT PRIMARY KEY, kind TEXT, payload TEXT, status TEXT, result TEXT, error TEXT, updated TEXT)")
        self.db.execute("CREATE TABLE IF NOT EXISTS audit (id INTEGER PRIMARY KEY AUTOINCREMENT, at TEXT, actor TEXT, action TEXT, detail TEXT)")

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    def create(self, job: str, kind: str, payload: dict) -> None:
        with self.lock, self.db:
            self.db.execute("INSERT INTO jobs VALUES (?, ?, ?, 'queued', NULL, NULL, ?)", (job, kind, json.dumps(payload), self._now()))

    def update(self, job: str, status: str, result: dict | None = None, error: str | None = None) -> None:
        if status not in self.STATES:
            raise ValueError(status)
        with self.lock, self.db:
            self.db.execute("UPDATE jobs SET status = ?, result = ?, error = ?, updated = ? WHERE id = ?", (status, None if result is None else json.dumps(result), error, self._now(), job))

    def get(self, job: str) -> dict | None:
        with self.lock:
            row = self.db.execute("SELECT id, kind, payload, status, result, error FROM jobs WHERE id = ?", (job,)).fetchone()
        return row and dict(id=row[0], kind=row[1], payload=json.loads(row[2]), status=row[3], result=row[4] and json.loads(row[4]), error=row[5])

    def log(self, actor: str, action: str, detail: dict) -> None:
        with self.lock, self.db:
            self.db.execute("INSERT INTO audit (at, actor, action, detail) VALUES (?, ?, ?, ?)", (self._now(), actor, action, json.dumps(detail)))

    def last(self, n: int = 50) -> list[tuple]:
        with self.lock:
            return self.db.execute("SELECT id, actor, action, detail FROM audit ORDER BY id DESC LIMIT ?", (n,)).fetchall()

    def purge(self, before: str) -> int:
        with self.lock, self.db:
            return self.db.execute("DELETE FROM audit WHERE at < ?", (before,)).rowcount


def token_fingerprint(token: str) -> str:
    """What the audit trail says of a token: 12 digits of its sha256."""
    return hashlib.sha256(token.encode()).hexdigest()[:12]


def backup(database: Path, folder: Path, stamp: str) -> Path:
    """A copy of a job store, whole even while it is written to."""
    if not database.exists():
        raise FileNotFoundError(database)
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{database.stem}_{stamp}.sqlite3"
    with closing(sqlite3.connect(database)) as source, closing(sqlite3.connect(target)) as copy:
        source.backup(copy)
    return target


def restore(copy: Path, database: Path) -> Path:
    """Puts a copy in the place of a job store."""
    if not copy.exists():
        raise FileNotFoundError(copy)
    database.parent.mkdir(parents=True, exist_ok=True)
    with closing(sqlite3.connect(copy)) as source, closing(sqlite3.connect(database)) as target:
        source.backup(target)
    return database


#: Rows of a sheet at most, without its head.
SHEET_ROWS = 1_048_575


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>" if math.isfinite(value) else "<c/>"
    text = escape("".join(c for c in str(value) if c >= " " or c in "\t\n\r"))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_sheet(path: Path, columns: list[str], rows: Iterable[tuple]) -> int:
    """Writes a workbook with one sheet, row by row; the number of rows. Nulls and infinite numbers are empty cells."""
    space = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>'.encode())
            for row in itertools.chain([tuple(columns)], rows):
                if n > SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows")
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                n += 1
            sheet.write(b"</sheetData></worksheet>")
    return n - 1


def put_artifact(root: Path, source: Path, key: str) -> Path:
    """Copies a file into a store of artifacts; keys can't leave it."""
    target = (root / key).resolve()
    if not target.is_relative_to(root.resolve()):
        raise ValueError(f"key outside the store: {key}")
    target.parent.mkdir(parents=True, exist_ok=True)
    return Path(shutil.copyfile(source, target))


class TimedCache:
    """Least recently used entries go first; entries expire after ``ttl`` seconds."""

    def __init__(self, most: int, ttl: float, clock=time.monotonic):
        self.most, self.ttl, self.clock, self.held = most, ttl, clock, OrderedDict()

    def get(self, key):
        value, until = self.held.get(key, (None, 0))
        if self.clock() >= until:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return value

    def set(self, key, value) -> None:
        self.held[key] = (value, self.clock() + self.ttl)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()
