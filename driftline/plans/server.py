"""Drill-down over HTTP: /health, /api/h3/summary, /api/h3/incidents, /api/h3/incidents.csv."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from driftline.operators import export, serving
from driftline.plans.pipeline import Store
from driftline.sources import sinks, tables

REPLAY_BASE = "https://replay.example/"


def _int(q: dict, key: str, default: int) -> int:
    return int(q.get(key, [default])[0])


class Api:
    """Requests as plain calls: (status, content type, body)."""

    def __init__(self, store: Store, replay_base: str = REPLAY_BASE) -> None:
        self.store, self.replay_base = store, replay_base

    def _json(self, status: int, value: object) -> tuple[int, str, str]:
        return status, "application/json", json.dumps(value, default=str)

    def get(self, url: str) -> tuple[int, str, str]:
        parts = urlparse(url)
        q = parse_qs(parts.query)
        try:
            if parts.path == "/health":
                return self.health()
            resolution, kind, cell = _int(q, "resolution", 0), q.get("type", [None])[0], serving.cell_number(q.get("cell", [""])[0])
            if not serving.checked(resolution, kind):
                return self._json(422, {"detail": "bad resolution or type"})
            if parts.path == "/api/h3/summary":
                return self.summary(resolution, cell, kind)
            if parts.path in ("/api/h3/incidents", "/api/h3/incidents.csv"):
                return self.incidents(resolution, cell, kind, _int(q, "limit", serving.DEFAULT_LIMIT), _int(q, "offset", 0), parts.path.endswith(".csv"))
        except ValueError as e:
            return self._json(422, {"detail": str(e)})
        return self._json(404, {"detail": "not found"})

    def attachment(self, url: str) -> str | None:
        """The file name under which the answer to a CSV request is to be saved."""
        parts = urlparse(url)
        q = parse_qs(parts.query)
        cell = serving.cell_number(q.get("cell", [""])[0])
        return f"incidents_h3_{cell}_r{_int(q, 'resolution', 0)}.csv" if parts.path.endswith(".csv") and cell is not None else None

    def health(self) -> tuple[int, str, str]:
        there = [r for r in self.store.config.resolutions if tables.modified(self.store.spark, self.store.path("cell_incidents", None, r)) is not None]
        return self._json(200 if there else 503, {"status": "ok" if there else "no data", "resolutions": there})

    def summary(self, resolution: int, cell: int | None, kind: str | None) -> tuple[int, str, str]:
        path = self.store.path("cell_incidents", None, resolution)
        if cell is None or tables.modified(self.store.spark, path) is None:
            return self._json(404, {"detail": "no such cell"})
        rows = sinks.json_rows(serving.summary(self.store.spark.read.parquet(path), cell, kind).limit(1))
        return self._json(200, rows[0]) if rows else self._json(404, {"detail": "no such cell"})

    def incidents(self, resolution: int, cell: int | None, kind: str | None, limit: int, offset: int, csv: bool) -> tuple[int, str, str]:
        paths = [self.store.path("mapping", None, resolution), self.store.path("incidents")]
        known = cell is not None and all(tables.modified(self.store.spark, p) is not None for p in paths)
        page = None
        if known:
            page = serving.incident_page(self.store.spark.read.parquet(paths[0]), self.store.spark.read.parquet(paths[1]), cell, kind, limit, offset)
        if csv:
            header = ",".join(export.CSV_COLUMNS) + "\r\n"
            return 200, "text/csv", sinks.csv_text(export.csv_rows(page)) if page is not None else header
        rows = sinks.json_rows(serving.with_replay(page, self.replay_base)) if page is not None else []
        return self._json(200, {"rows": rows, "meta": {"count": len(rows), "limit": limit, "offset": offset}})


def serve(store: Store, host: str, port: int) -> None:
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            status, kind, body = api.get(self.path)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if status == 200 and (name := api.attachment(self.path)):
                self.send_header("Content-Disposition", f"attachment; filename={name}")
            self.end_headers()
            self.wfile.write(body.encode())

    ThreadingHTTPServer((host, port), Handler).serve_forever()
