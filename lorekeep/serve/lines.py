"""Line protocol: a program per line; results, then OK, or one ERR line."""

from __future__ import annotations

import socketserver
from threading import Lock
from typing import TextIO

from ..lang.parser import parse
from ..plans.analyzer import analyze
from ..plans.nodes import CreateTable
from ..session import Session
from .render import line as render_line


class LineServer:
    def __init__(self, session: Session):
        self.session, self.declared = session, {}

    def handle_line(self, text: str) -> str:
        if not text.strip():
            return ""
        try:
            plan = parse(text)
            checked = analyze(plan, self.declared | dict.fromkeys(self.session.sources))
            out = [render_line(r) for r in self.session.execute(checked)]
        except (ValueError, TypeError) as e:
            return f"ERR {e}"
        self.declared |= {s.table: s.dim for s in plan if isinstance(s, CreateTable)}
        return "\n".join([*out, "OK"])

    def serve(self, source: TextIO, sink: TextIO) -> None:
        for text in source:
            if answer := self.handle_line(text):
                print(answer, file=sink, flush=True)


def serve_tcp(session: Session, host: str = "127.0.0.1", port: int = 0) -> socketserver.ThreadingTCPServer:
    """A server, bound and not yet started; each connection speaks the line protocol. Programs run one after another."""
    lock = Lock()

    class Connection(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            server = LineServer(session)
            for raw in self.rfile:
                with lock:
                    answer = server.handle_line(raw.decode("utf-8", "replace"))
                if answer:
                    self.wfile.write(f"{answer}\n".encode())

    class Server(socketserver.ThreadingTCPServer):
        daemon_threads = allow_reuse_address = True

    return Server((host, port), Connection)
