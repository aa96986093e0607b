"""The engine behind a small HTTP server, with the paths that senders and dashboards of pushed samples use."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError, URLError
from urllib.parse import parse_qs, parse_qsl, urlencode, urlsplit
from urllib.request import Request, urlopen

from tidepane.engine import Engine, Incoming, Reply
from tidepane.functions.promfmt import error_response

#: Tells how a query was answered.
EXECUTION_HEADER = "x-tidepane-execution"
FORWARD_TIMEOUT_S = 120.0
# Headers of one connection, by the HTTP standard, and those that are made anew for each (fixed values).
HOP_BY_HOP = {"connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length"}
OWN_HEADERS = {"server", "date", EXECUTION_HEADER}


def header_text(text: str) -> str:
    """Text that is safe in a header: visible ASCII only."""
    return "".join(c if " " <= c <= "~" else "?" for c in text)


def _end_to_end(headers: Iterable[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """Headers that go on to the other end: not those of this connection, nor those it names."""
    headers = list(headers)
    named = {x.strip().lower() for k, v in headers if k.lower() == "connection" for x in v.split(",")}
    return tuple((k, v) for k, v in headers if k.lower() not in HOP_BY_HOP | named)


def forwarder(base: str, timeout_s: float = FORWARD_TIMEOUT_S) -> Callable[[Incoming], Reply]:
    """Forwards what the plan does not answer to the server at ``base``, by its method and with its body and headers; 502 if that cannot be reached in time."""

    def forward(request: Incoming) -> Reply:
        text = urlencode(request.params) if request.url_query is None else request.url_query
        asked = Request(base.rstrip("/") + request.path + (f"?{text}" if text else ""), data=request.body if request.method == "POST" else None, method=request.method)
        for name, value in _end_to_end(request.headers):
            asked.add_header(name, value)
        try:
            with urlopen(asked, timeout=timeout_s) as r:
                return _reply(r.status, r.headers.items(), r.read())
        except HTTPError as e:
            return _reply(e.code, e.headers.items(), e.read())
        except (URLError, TimeoutError, ValueError, OSError) as e:
            return Reply(502, error_response("forward", str(e)))

    return forward


def _reply(status: int, headers: Iterable[tuple[str, str]], data: bytes) -> Reply:
    try:
        body = json.loads(data or b"null")
    except ValueError:
        body = None
    return Reply(status, body, headers=_end_to_end(headers), raw=data)


def route(engine: Engine, method: str, target: str, body: bytes, headers: Iterable[tuple[str, str]] = ()) -> Reply:
    """Reply to a request."""
    url = urlsplit(target)
    form = body.decode("utf-8", "replace") if method == "POST" else ""
    request = Incoming(url.path, dict(parse_qsl(f"{url.query}&{form}")), method, url.query, body, tuple(headers))
    match method, url.path:
        case "POST", "/api/v1/write":
            return engine.write_body(body)
        case ("GET" | "POST"), "/api/v1/query":
            return engine.query_request(url.query, form, request)
        case ("GET" | "POST"), "/api/v1/query_range":
            return engine.query_range(request.params, request)
        case "GET", "/api/v1/status/engine":
            return Reply(200, {"status": "success", "data": engine.status()})
        case "POST", "/api/v1/precompute/watermark":
            return engine.advance_watermark(parse_qs(url.query).get("time_ms", [None])[0])
        case "GET", "/-/ready":
            return Reply(200 if engine.ready() else 503, {})
    return Reply(404, {})


def server(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for the engine; call ``serve_forever`` on it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _serve(self) -> None:
            body = self.rfile.read(int(self.headers.get("content-length") or 0))
            reply = route(engine, self.command, self.path, body, self.headers.items())
            data = reply.raw if reply.raw is not None else b"" if reply.body is None else json.dumps(reply.body).encode()
            self.send_response(reply.status)
            for name, value in reply.headers:
                if name.lower() not in OWN_HEADERS:
                    self.send_header(name, value)
            if reply.execution:
                self.send_header(EXECUTION_HEADER, header_text(reply.execution))
            if data and not any(k.lower() == "content-type" for k, _ in reply.headers):
                self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _serve

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
