"""Command line: read, verify, route, status, replay, and serve over HTTP."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qsl, urlsplit
from uuid import uuid4

from pyspark.sql import functions as F

from tidelog import config as options
from tidelog.agent import Agent
from tidelog.functions.codec import decoded
from tidelog.operators import delivery
from tidelog.plans import status as shown
from tidelog.plans.records import ReadQuery, read_records
from tidelog.session import session
from tidelog.sources import recovery, state
from tidelog.sources import segments as seg
from tidelog.streaming.pipelines import http_sink, null_sink, stdout_sink

_PARAMS = ("shard", "seq_from", "seq_to", "time_from", "time_to", "source_id", "agent_id", "include_archive", "limit")


def true_text(text: str) -> bool:
    return text.lower() in ("1", "true", "yes", "on")


def _records(spark, config, params: dict):
    return read_records(spark, config.log_dir, config.archive_dir, config.file_prefix, ReadQuery.from_params(params))


def _handler(spark, config, landing: str, most_bytes: int, agent: Agent | None):
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, code: int, body) -> None:
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            params = dict(parse_qsl(at.query, keep_blank_values=True))
            try:
                if at.path == "/v1/records":
                    found = _records(spark, config, params)
                    rows = found.select(shown.record_json().alias("j")).collect()
                    more = ""
                    if true_text(params.get("export_sink_batch", "")):
                        bodies = [r["body"] for r in shown.export_batch(found, params.get("agent_id")).orderBy("shard").collect()]
                        more = ',"sink_batch_json":[' + ",".join(bodies) + "]"
                    return self._reply(200, '{"records":[' + ",".join(r["j"] for r in rows) + "]" + more + "}")
                if at.path == "/v1/status":
                    row = shown.status(spark, config, agent and agent.manager, agent.status()["recovery_fallback_reason"] if agent else "none").first().asDict()
                    return self._reply(200, row | (agent.status() if agent else {}))
                if at.path == "/v1/route":
                    return self._reply(200, shown.route_json(config, params.get("key", "")))
                return self._reply(404, {"error": "no such path"})
            except ValueError as e:
                return self._reply(400, {"error": str(e)})
            except Exception as e:
                return self._reply(503, {"error": f"the engine failed: {type(e).__name__}"})

        def do_POST(self) -> None:  # noqa: N802
            if urlsplit(self.path).path != "/v1/logs":
                return self._reply(404, {"error": "no such path"})
            if agent is not None and agent.pressure() != "none":
                agent.stats["rejected"] += 1
                return self._reply(503, {"error": f"paused: {agent.pressure()}"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > most_bytes:
                return self._reply(413, {"error": "request too large"})
            body = self.rfile.read(size).decode("utf-8", "replace")
            if not body.strip():
                return self._reply(400, {"error": "empty request"})
            # A landing file for each request, renamed into place; a file stream takes it from there.
            path = Path(landing, f"{uuid4().hex}.txt")
            draft = path.with_name(f"_{path.name}.part")
            try:
                draft.write_text(body)
                draft.rename(path)
            except OSError as e:
                return self._reply(503, {"error": f"the request could not be stored: {e.strerror}"})
            try:
                many = json.loads(body).get("records")
                accepted = len(many) if isinstance(many, list) and many and all(isinstance(x, dict) for x in many) else 1
            except (ValueError, AttributeError):
                accepted = 1
            return self._reply(200, {"accepted": accepted})

        def log_message(self, *_args) -> None:
            pass

    return Handler


def server(spark, config, landing: str, port: int = 0, most_bytes: int = 1 << 20, agent: Agent | None = None) -> ThreadingHTTPServer:
    """Queries and ingest over HTTP; ``serve_forever`` runs it. ``agent`` takes the requests from ``landing``; while it has pressure, they get 503."""
    return ThreadingHTTPServer(("127.0.0.1", port), _handler(spark, config, landing, most_bytes, agent))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    parser.add_argument("command", choices=["read", "verify", "route", "status", "replay", "serve", "agent"])
    parser.add_argument("--config")
    parser.add_argument("--log-dir")
    parser.add_argument("--archive-dir")
    parser.add_argument("--key", default="")
    parser.add_argument("--offsets", help="offset file for replay")
    parser.add_argument("--landing", default="landing")
    parser.add_argument("--follow", default="", help="files and globs that the agent follows, comma-separated")
    parser.add_argument("--sink-url", default="", help="where the agent posts batches; without it they go to standard output")
    parser.add_argument("--export-sink-batch", action="store_true", help="read: print sink batches instead of lines")
    parser.add_argument("--port", type=int, default=18081)
    parser.add_argument("--master", default=None)
    for name in _PARAMS:
        parser.add_argument(f"--{name.replace('_', '-')}")
    given = parser.parse_args(argv)
    config = options.load(given.config, **{k: v for k in ("log_dir", "archive_dir") if (v := getattr(given, k))})
    if given.command == "route":
        print(json.dumps(shown.route_json(config, given.key)))
        return 0
    spark = session(given.master)
    if given.command == "read":
        params = {k: v for k in _PARAMS if (v := getattr(given, k)) is not None}
        rows = _records(spark, config, params)
        rows = shown.export_batch(rows, given.agent_id).select("body") if given.export_sink_batch else rows.select("line")
        for row in rows.toLocalIterator():
            print(row[0])
    elif given.command == "verify":
        found = seg.segments(spark, config.log_dir, config.archive_dir, config.file_prefix)
        rows = decoded(seg.lines(spark, [r["path"] for r in found.collect()]))
        for row in seg.verified_prefix(rows).orderBy("seg_path").toLocalIterator():
            print(f"{row['seg_path']} valid_records={row['valid_records']} next_sequence={row['next_sequence']} valid_size={row['valid_size']}")
        total = recovery.totals(seg.verified_prefix(rows)).first()
        print(f"total segments={total['segments']} valid_records={total['valid_records']} valid_size={total['valid_size']}")
    elif given.command == "status":
        print(json.dumps(shown.status(spark, config).first().asDict()))
    elif given.command == "replay":
        offsets = state.offset_table(spark, given.offsets) if given.offsets else spark.createDataFrame([], "shard int, next_sequence long")
        every = read_records(spark, config.log_dir, config.archive_dir, config.file_prefix, ReadQuery(limit=None))
        made = delivery.replay_batches(every, offsets, config.sink_batch_size)
        for row in made.select(delivery.delivery_json(F.lit("replay")).alias("body")).toLocalIterator():
            print(row["body"])
    else:
        Path(given.landing).mkdir(parents=True, exist_ok=True)
        send = http_sink(given.sink_url) if given.sink_url else stdout_sink
        agent = Agent(spark, config, send if given.command == "agent" else null_sink, given.agent_id or "agent")
        agent.start(Path(given.landing).absolute().as_uri(), [p for p in given.follow.split(",") if p])
        if given.command == "agent":
            threading.Thread(target=agent.deliver, args=(lambda: False,), daemon=True).start()
        server(spark, config, given.landing, given.port, agent=agent).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
