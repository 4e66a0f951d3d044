"""HTTP interface of an engine: SPARQL, SQL, statistics, geometries and blobs.

answer() holds all rules and needs no socket; serve() puts it behind a server.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import PySparkException

from tessera.engine import Engine
from tessera.functions import sinks, terms
from tessera.schema import TesseraError

RESULTS = "application/sparql-results+json"
JSON = "application/json"


class HttpError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def accepts(header: str, *types: str) -> bool:
    """Whether an Accept header takes one of the types; none at all takes everything."""
    wanted = [part.split(";") for part in header.split(",") if part.strip()]
    wanted = [w[0].strip().lower() for w in wanted if not any(re.fullmatch(r"\s*q=0(\.0*)?\s*", x) for x in w[1:])]
    return not header.strip() or any(w in ("*/*", t, t.split("/")[0] + "/*") for w in wanted for t in types)


def query_text(method: str, params: dict, headers: dict, body: bytes) -> str:
    """The query of a SPARQL request: a parameter, a form or the body itself."""
    if method == "GET":
        text = params.get("query", [""])[0]
    else:
        kind = headers.get("content-type", "").split(";")[0].strip().lower()
        if kind == "application/x-www-form-urlencoded":
            text = parse_qs(body.decode()).get("query", [""])[0]
        elif kind == "application/sparql-query":
            text = body.decode()
        else:
            raise HttpError(415, f"content type {kind or 'none'} is not supported")
    if not text.strip():
        raise HttpError(400, "the query is missing")
    return text


def _number(params: dict, name: str, default: int) -> int:
    text = params.get(name, [str(default)])[0]
    if not re.fullmatch(r"-?[0-9]+", text):
        raise HttpError(400, f"{name} is no whole number")
    return int(text)


def _route(engine: Engine, method: str, path: str, params: dict, headers: dict, body: bytes, blobs: str | None):
    allowed = {"/sparql": ("GET", "POST"), "/api/sql": ("POST",), "/api/stats": ("GET",), "/geometries": ("GET",), "/geometries/extent": ("GET",)}
    if path.startswith("/blobs/"):
        digest = path[len("/blobs/") :].removeprefix("urn:sha256:")
        if method != "GET":
            raise HttpError(405, "only GET")
        if not re.fullmatch(r"[0-9a-f]{64}", digest):
            raise HttpError(400, "a blob is named by 64 lowercase hex digits")
        file = Path(blobs or "", digest)
        if not blobs or not file.is_file():
            raise HttpError(404, "there is no such blob")
        return "application/octet-stream", file.read_bytes()
    if path not in allowed:
        raise HttpError(404, "there is nothing here")
    if method not in allowed[path]:
        raise HttpError(405, f"only {' and '.join(allowed[path])}")
    if path == "/sparql":
        if not accepts(headers.get("accept", ""), RESULTS, JSON):
            raise HttpError(406, f"results are given as {RESULTS}")
        df = engine.sparql(query_text(method, params, headers, body))
        rows = [r["binding"] for r in sinks.sparql_json(df).toLocalIterator()]
        return RESULTS, f'{{"head": {{"vars": {json.dumps(df.columns)}}}, "results": {{"bindings": [{", ".join(rows)}]}}}}'.encode()
    if path == "/api/sql":
        try:
            text = json.loads(body or b"{}").get("query", "")
        except (ValueError, AttributeError) as e:
            raise HttpError(400, "the body is a JSON object with a query") from e
        if not text.strip():
            raise HttpError(400, "the query is missing")
        return JSON, json.dumps(sinks.sql_response(engine.sql(text))).encode()
    if path == "/api/stats":
        stats = engine.stats()
        return JSON, json.dumps({"counts": stats["counts"], "columns": [r.asDict() for r in terms.render_text(stats["columns"]).collect()]}).encode()
    if path == "/geometries/extent":
        return "application/geo+json", sinks.extent_feature(engine.extent()).encode()
    page = engine.geometries(params.get("bbox", [None])[0], _number(params, "limit", 1000), _number(params, "offset", 0))
    return "application/geo+json", sinks.feature_collection(page).encode()


def answer(engine: Engine, method: str, target: str, headers: dict[str, str] | None = None, body: bytes = b"", blobs: str | None = None) -> tuple[int, str, bytes]:
    """(status, content type, body) of a request; header names are in lower case."""
    url = urlsplit(target)
    try:
        kind, out = _route(engine, method, url.path, parse_qs(url.query), headers or {}, body, blobs)
        return 200, kind, out
    except HttpError as e:
        status, text = e.status, str(e)
    except (TesseraError, PySparkException, UnicodeDecodeError) as e:
        status, text = 400, str(e)
    return status, JSON, json.dumps({"error": text}).encode()


def serve(engine: Engine, port: int = 8080, host: str = "127.0.0.1", blobs: str | None = None) -> None:
    """Answer requests until stopped."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = answer(engine, self.command, self.path, {k.lower(): v for k, v in self.headers.items()}, body, blobs)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_PUT = do_DELETE = _any

    ThreadingHTTPServer((host, port), Handler).serve_forever()
