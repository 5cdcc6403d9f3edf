"""The serving surface over HTTP: routes to ``service.Service``, and the built files of a folder."""

from __future__ import annotations

import json
import os
import tempfile
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from geoloom import export
from geoloom.service import Service, ServiceError

TYPES = {".html": "text/html", ".json": "application/json", ".js": "text/javascript", ".css": "text/css", ".csv": "text/csv", ".geojson": "application/geo+json", ".svg": "image/svg+xml"}


def static_file(folder: str, path: str) -> str | None:
    """The file that a path names below ``folder``; None if it leaves the folder or names none."""
    root = os.path.realpath(folder)
    full = os.path.realpath(os.path.join(root, urllib.parse.unquote(path).lstrip("/") or "index.html"))
    inside = full == root or full.startswith(root + os.sep)
    return full if inside and os.path.isfile(full) else None


def answer(svc: Service, path: str, as_of: str) -> tuple[str, bytes]:
    """(content type, body) of a GET on /api; ServiceError where the answer is an error."""
    route = urllib.parse.urlsplit(path)
    params = urllib.parse.parse_qs(route.query)
    one = lambda k, v=None: params.get(k, [v])[-1]
    parts = [urllib.parse.unquote(p) for p in route.path.strip("/").split("/")][1:]
    name, rest = (parts[0] if parts else ""), parts[1:]
    if name == "health":
        out = svc.health()
    elif name == "meta":
        out = svc.meta()
    elif name == "sites":
        out = {"site": svc.site("/".join(rest), as_of)} if rest else svc.search(params)
    elif name == "nearest":
        try:
            out = {"sites": svc.nearest(float(one("lat")), float(one("lng")), int(one("n", "5")))}
        except (TypeError, ValueError) as e:
            raise ServiceError("BAD_QUERY", "lat and lng are required numbers, n is a whole one") from e
    elif name == "stats":
        out = svc.stats()
    elif name == "export":
        fmt = (rest[0] if rest else one("format", "csv")).lower()
        with tempfile.TemporaryDirectory() as folder:
            made = svc.export(fmt, f"file://{folder}/out")
            file = f"{folder}/one"
            export.join_parts(svc.sites.sparkSession, made, f"file://{file}")
            with open(file, "rb") as f:
                return TYPES.get(f".{fmt}", "text/plain"), f.read()
    else:
        raise ServiceError("NOT_FOUND", f"no route /api/{name}")
    return "application/json", json.dumps(out, default=str, ensure_ascii=False).encode()


def serve(svc: Service, as_of: str, folder: str | None = None, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that answers GET and HEAD; start it with ``serve_forever``."""
    began = time.monotonic()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, body: bytes) -> None:
            self.send_response(status)
            self.send_header("content-type", f"{kind}; charset=utf-8")
            self.send_header("content-length", str(len(body)))
            self.send_header("x-uptime-seconds", str(round(time.monotonic() - began)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def _fail(self, e: ServiceError) -> None:
            self._send(e.status, "application/json", json.dumps({"error": {"code": e.code, "message": str(e)}}).encode())

        def do_GET(self) -> None:
            try:
                if self.path.split("?")[0].startswith("/api/"):
                    return self._send(200, *answer(svc, self.path, as_of))
                file = static_file(folder, urllib.parse.urlsplit(self.path).path) if folder else None
                if file is None:
                    raise ServiceError("NOT_FOUND", f"no file {self.path}")
                with open(file, "rb") as f:
                    return self._send(200, TYPES.get(os.path.splitext(file)[1], "application/octet-stream"), f.read())
            except ServiceError as e:
                self._fail(e)
            except Exception as e:  # an answer, whatever went wrong
                self._fail(ServiceError("INTERNAL", type(e).__name__))

        do_HEAD = do_GET

        def _refuse(self) -> None:
            self._fail(ServiceError("METHOD_NOT_ALLOWED", f"{self.command} is not allowed"))

        do_POST = do_PUT = do_DELETE = do_PATCH = _refuse

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
