"""A service that embeds texts over HTTP: one model for many clients. For embed.http_model() and choose_embedder()."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from codeweft.functions import embed as M


def serve(port: int = 0, host: str = "127.0.0.1", factory: Callable = M.hashing_model, model: str = M.MODEL, version: str = M.VERSION) -> ThreadingHTTPServer:
    """Starts the service in a thread. GET /health: status, model, dim, version. POST /embed: texts and batch_size in,
    model, dim and embeddings out; texts are embedded as they come. The port is server_address[1]; shutdown() ends it."""
    embed, busy = factory(), threading.Lock()
    dim = len(embed(["warm-up"])[0])

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - the name that http.server calls
            self._answer(*((200, {"status": "ok", "model": model, "dim": dim, "version": version}) if self.path == "/health" else (404, {"error": "no such path"})))

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/embed":
                return self._answer(404, {"error": "no such path"})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                texts, batch = asked["texts"], int(asked.get("batch_size") or 64)
                if not all(isinstance(t, str) for t in texts):
                    raise TypeError("texts are strings")
            except (ValueError, KeyError, TypeError) as e:
                return self._answer(400, {"error": str(e)})
            with busy:
                found = [v.tolist() for at in range(0, len(texts), batch) for v in embed(texts[at : at + batch])]
            return self._answer(200, {"model": model, "dim": dim, "embeddings": found})

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
