"""A read-only HTTP query interface around one session.

GET /query?q=... and POST /query (body: SQL) with the header X-Password return a JSON array of
all rows; a failing query returns {"error": ...} with status 200. Results pass through the driver,
so ``spark.driver.maxResultSize`` is what bounds them. GET /auth checks the day's cookie and sends
others to the login page. Statements run side by side, in fair pools that they take in turn,
and are written to the audit log.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import json
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from govlake.plans.sqlgate import Gate
from govlake.sources.catalog import rows_as_json

#: Fair pools that requests take in turn; Spark keeps a pool once it has one.
POOLS = 64
_turn = itertools.count()

LOGIN = (
    "<!DOCTYPE html><html><head><title>Login</title></head><body>"
    "<form method='post' action='/login'><label>Password <input type='password' name='password' autofocus></label> <button>Enter</button></form>"
    "</body></html>"
)


def day_token(secret: str, day: date | None = None) -> str:
    day = day or datetime.now(UTC).date()
    return hmac.new(secret.encode(), day.isoformat().encode(), hashlib.sha256).hexdigest()


def valid_token(secret: str, token: str) -> bool:
    """Today's or yesterday's."""
    today = datetime.now(UTC).date()
    return any(hmac.compare_digest(token, day_token(secret, d)) for d in (today, today - timedelta(days=1)))


def answer(gate: Gate, sql: str, log: Callable[[str, str, bool, str | None], None] | None = None) -> str:
    """The JSON payload for a statement."""
    error = None
    try:
        gate.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"request-{next(_turn) % POOLS}")  # of this thread
        rows = rows_as_json(gate.run(sql)).collect()
        out = "[" + ",".join(r.json for r in rows) + "]"
    except Exception as e:  # every failure is a payload
        error = str(e)
        out = json.dumps({"error": error})
    if log:
        log("", sql, error is None, error)
    return out


def make_server(gate: Gate, password: str, host: str = "127.0.0.1", port: int = 8081, log=None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def _send(self, status: int, body: str, kind: str = "application/json", headers: dict | None = None) -> None:
            data = body.encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(data)), **(headers or {})}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _allowed(self) -> bool:
            return hmac.compare_digest(self.headers.get("X-Password", "").encode(), password.encode())

        def _query(self, sql: str) -> None:
            if not self._allowed():
                self._send(401, json.dumps({"error": "unauthorized"}))
            elif not sql.strip():
                self._send(400, json.dumps({"error": "empty query"}))
            else:
                self._send(200, answer(gate, sql, log))

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/health":
                self._send(200, "ok", "text/plain")
            elif url.path == "/query":
                self._query(parse_qs(url.query).get("q", [""])[0])
            elif url.path == "/auth":
                cookies = dict(c.strip().split("=", 1) for c in self.headers.get("Cookie", "").split(";") if "=" in c)
                known = valid_token(password, cookies.get("session", ""))
                self._send(200 if known else 302, "", headers=None if known else {"Location": "/login"})
            elif url.path in ("/", "/login"):
                self._send(200, LOGIN, "text/html; charset=utf-8")
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            if self.path == "/query":
                self._query(body)
            elif self.path == "/login":
                given = parse_qs(body).get("password", [""])[0]
                ok = hmac.compare_digest(given.encode(), password.encode())
                if ok:
                    self._send(302, "", headers={"Set-Cookie": f"session={day_token(password)}; Path=/; HttpOnly; SameSite=Strict", "Location": "/"})
                else:
                    self._send(401, LOGIN, "text/html; charset=utf-8")
            else:
                self._send(404, json.dumps({"error": "not found"}))

        def do_OPTIONS(self) -> None:
            self._send(204, "")

    return ThreadingHTTPServer((host, port), Handler)
