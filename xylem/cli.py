"""Command line: import documents, render a model, explore it in a browser."""

from __future__ import annotations

import argparse
import html
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from xylem.api import DataModel
from xylem.plans.config import load_config, parse_config
from xylem.plans.dialects import DIALECTS


def rendered(model: DataModel, what: str, dialect: str | None = None) -> str:
    texts = {
        "erd": model.get_entity_rel_diagram,
        "source-tree": lambda: model.source_tree,
        "target-tree": lambda: model.target_tree,
        "ddl": lambda: ";\n\n".join(model.get_all_create_table_statements(dialect) + (model.get_all_create_index_statements(dialect) if dialect else [])) + ";\n",
    }
    return texts[what]()


def import_(args: argparse.Namespace) -> None:
    model = DataModel(args.xsd, args.name, model_config=load_config(args.config) if args.config else None, connection_string=args.store, db_type=args.store_type, db_schema=args.schema)
    stats = model.parse_xml(args.xml, skip_validation=not args.validate, recover=args.recover).insert_into_target_tables()
    for name, n in stats.inserted.items():
        print(f"{name}: {n} new, {stats.existing.get(name, 0)} known")
    print(f"staging {stats.duration_temp_insert:.1f} s, merge {stats.duration_merge:.1f} s, cleanup {stats.duration_cleanup:.1f} s")


def render(args: argparse.Namespace) -> None:
    model = DataModel(args.xsd, args.name, model_config=load_config(args.config) if args.config else None)
    print(rendered(model, args.what, args.dialect))


class Explorer:
    """Outputs of a configuration that can be edited; the last good ones stay while it has errors."""

    def __init__(self, xsd: str, name: str, config: str | None):
        self.xsd, self.name, self.path, self.lock = xsd, name, config, threading.Lock()
        text = ""
        if config:
            with open(config, encoding="utf-8") as f:
                text = f.read()
        self.good: dict[str, str] = {}
        self.update(text)

    def update(self, text: str) -> None:
        with self.lock:
            self.text, self.error = text, ""
            try:
                model = DataModel(self.xsd, self.name, model_config=parse_config(text))
                self.good = {k: rendered(model, k) for k in ("target-tree", "source-tree", "erd", "ddl")}
            except ValueError as e:
                self.error = str(e)

    def save(self) -> None:
        with self.lock:
            if self.path and not self.error:
                with open(self.path, "w", encoding="utf-8") as f:
                    f.write(self.text)

    def page(self) -> str:
        with self.lock:
            parts = "".join(f"<h2>{k}</h2><pre>{html.escape(v)}</pre>" for k, v in self.good.items())
            form = f'<form method="post" action="/config"><textarea name="config" rows="20" cols="80">{html.escape(self.text)}</textarea><br><button>Apply</button><button formaction="/save">Save</button></form>'
            return f"<!doctype html><title>{html.escape(self.name)}</title><p>{html.escape(self.error)}</p>{form}{parts}"


def server(explorer: Explorer, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = explorer.page().encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:  # noqa: N802
            data = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            explorer.update(parse_qs(data, keep_blank_values=True).get("config", [""])[0])
            if self.path == "/save":
                explorer.save()
            self.do_GET()

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(args: argparse.Namespace) -> None:
    with server(Explorer(args.xsd, args.name, args.config), args.port) as running:
        print(f"http://127.0.0.1:{running.server_port}/")
        running.serve_forever()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="xylem")
    commands = out.add_subparsers(required=True)
    for name, run in (("import", import_), ("render", render), ("serve", serve)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("xsd")
        sub.add_argument("--name", default="DocumentRoot")
        sub.add_argument("--config")
        if name == "import":
            sub.add_argument("xml", nargs="+")
            sub.add_argument("--store", required=True)
            sub.add_argument("--store-type", default="parquet")
            sub.add_argument("--schema")
            sub.add_argument("--validate", action="store_true")
            sub.add_argument("--recover", action="store_true")
        elif name == "render":
            sub.add_argument("--what", choices=("erd", "target-tree", "source-tree", "ddl"), default="target-tree")
            sub.add_argument("--dialect", choices=tuple(DIALECTS))
        else:
            sub.add_argument("--port", type=int, default=8000)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
