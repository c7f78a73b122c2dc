"""Requests and answers of the engine as plain JSON values, and a small HTTP server for them.

Service.handle() does what a request asks for and can be called without a server. Bounds of requests are checked before
anything is read or written.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from korvex.operators import fusion
from korvex.plans import pipeline
from korvex.plans.engine import Engine
from korvex.sources import ingest
from korvex.sources.shards import Shards

MOST_RESULTS = 1000
_NUMBERS, _WHOLES, _TEXTS = (lambda v: isinstance(v, list) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)), (lambda v: isinstance(v, list) and all(type(x) is int for x in v)), (lambda v: isinstance(v, dict) and all(isinstance(x, str) for x in v.values()))
_TEXT, _TABLE, _FLAG = (lambda v: isinstance(v, str)), (lambda v: isinstance(v, dict)), (lambda v: isinstance(v, bool))
#: name: (check, whether it must be there)
SEARCH = {"dense_vector": (_NUMBERS, False), "sparse_indices": (_WHOLES, False), "sparse_values": (_NUMBERS, False), "text_query": (_TEXT, False), "top_k": (lambda v: type(v) is int and 1 <= v <= MOST_RESULTS, False), "namespace": (_TEXT, False), "fusion": (lambda v: v in fusion.METHODS, False), "include_payloads": (_FLAG, False), "filter": (_TABLE, False), "filter_mode": (lambda v: v in ("pre", "post"), False)}
UPSERT = {"id": (_TEXT, True), "dense_vector": (_NUMBERS, False), "sparse_indices": (_WHOLES, False), "sparse_values": (_NUMBERS, False), "text_fields": (_TEXTS, False), "payload": (_TABLE, False), "namespace": (_TEXT, False)}
DELETE = {"id": (_TEXT, True), "namespace": (_TEXT, False)}
PIPELINE = {"stages": (lambda v: isinstance(v, list) and len(v) > 0 and all(_TABLE(s) and _TEXT(s.get("stage_type")) and _TABLE(s.get("params", {})) for s in v), True), "namespace": (_TEXT, False), "stream": (_FLAG, False)}
INGEST = {"path": (_TEXT, True), "extractors": (lambda v: isinstance(v, list) and len(v) > 0 and all(map(_TEXT, v)), True)}


class Refused(ValueError):
    """A request that breaks its bounds."""


def checked(body: dict, fields: dict) -> dict:
    """The body without nulls; an unknown, missing or wrong field raises Refused."""
    if not isinstance(body, dict):
        raise Refused("an object is expected")
    given = {k: v for k, v in body.items() if v is not None}
    for name, (ok, needed) in fields.items():
        if needed and name not in given:
            raise Refused(f"{name} is missing")
        if name in given and not ok(given[name]):
            raise Refused(f"{name} is wrong")
    if odd := sorted(set(given) - set(fields)):
        raise Refused(f"unknown: {', '.join(odd)}")
    if ("sparse_indices" in given) != ("sparse_values" in given) or len(given.get("sparse_indices", [])) != len(given.get("sparse_values", [])):
        raise Refused("sparse_indices and sparse_values come together and are of one length")
    return given


class Service:
    """An engine, its ingest jobs and, if there are any, shards."""

    def __init__(self, engine: Engine, shards: Shards | None = None):
        self.engine, self.shards, self.jobs = engine, shards, ingest.Jobs(engine.store)
        self.routes: list[tuple[str, str, Callable]] = [
            ("POST", "/search", self.search), ("POST", "/upsert", self.upsert), ("POST", "/upsert/batch", self.batch_upsert), ("POST", "/delete", self.delete), ("POST", "/pipeline", self.pipeline),
            ("POST", "/namespaces/([^/]+)/ingest", self.ingest), ("POST", "/namespaces/([^/]+)/ingest/batch", self.ingest_batch), ("POST", "/jobs/([^/]+)/cancel", self.cancel), ("POST", "/snapshot", lambda body: {"sequence": self.engine.snapshot()}),
            ("GET", "/health", lambda body: {"status": "ok"}), ("GET", "/stats", self.stats), ("GET", "/catalog", self.catalog), ("GET", "/tenants", self.tenants), ("GET", "/tenants/([^/]+)/shards", self.tenant_shards), ("GET", "/jobs/([^/]+)", self.job), ("GET", "/metrics", lambda body: self.engine.counters.text()),
        ]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
        """(status, answer). An answer is a JSON value, a text or, of a streamed pipeline, an iterator of events."""
        for m, pattern, do in self.routes:
            found = re.fullmatch(pattern, path)
            if found and m == method:
                try:
                    return 200, do(*found.groups(), {} if body is None else body)
                except (Refused, ValueError) as e:
                    return 422, {"error": str(e).split("\n")[0]}
                except KeyError as e:
                    return 404, {"error": str(e.args[0]) if e.args else "not found"}
                except Exception as e:  # noqa: BLE001  the server goes on
                    return 500, {"error": str(e).split("\n")[0]}
        known = [m for m, p, _ in self.routes if re.fullmatch(p, path)]
        return (405, {"error": f"{path} takes {', '.join(known)}"}) if known else (404, {"error": f"no {path}"})

    def _fits(self, r: dict) -> dict:
        dim = self.engine.store.dim
        if "dense_vector" in r and dim is not None and len(r["dense_vector"]) != dim:
            raise Refused(f"dense_vector has {len(r['dense_vector'])} numbers, {dim} expected")
        return r

    def search(self, body: dict) -> dict:
        r = self._fits(checked(body, SEARCH))
        began = time.perf_counter()
        payloads = r.get("include_payloads", False)
        rows = self.engine.search(r.get("dense_vector"), r.get("sparse_indices"), r.get("sparse_values"), r.get("text_query"), r.get("top_k", 10), r.get("namespace", "default"), payloads, fusion=r.get("fusion", "rrf"), filter=r.get("filter"), filter_mode=r.get("filter_mode", "post")).collect()
        results = [{"id": x["id"], "score": x["score"]} | ({"payload": json.loads(x["payload"]) if x["payload"] else None} if payloads else {}) for x in rows]
        return {"results": results, "latency_ms": (time.perf_counter() - began) * 1000, "shards_queried": 1, "shards_failed": 0}

    @staticmethod
    def _document(r: dict) -> dict:
        return {"id": r["id"], "dense": r.get("dense_vector"), "sparse_indices": r.get("sparse_indices"), "sparse_values": r.get("sparse_values"), "text_fields": r.get("text_fields"), "payload": r.get("payload"), "namespace": r.get("namespace", "default")}

    def upsert(self, body: dict) -> dict:
        return {"sequence": self.engine.batch_upsert([self._document(checked(body, UPSERT))])}

    def batch_upsert(self, body: dict) -> dict:
        rows = [self._document(checked(x, UPSERT)) for x in checked(body, {"documents": (lambda v: isinstance(v, list) and len(v) > 0, True)})["documents"]]
        return {"sequence": self.engine.batch_upsert(rows), "count": len(rows)}

    def delete(self, body: dict) -> dict:
        r = checked(body, DELETE)
        found = self.engine.delete(r["id"], r.get("namespace", "default"))
        return {"found": found, "sequence": self.engine.store.sequence()}

    def stats(self, body: dict) -> dict:
        return {"namespaces": [r.asDict() for r in self.engine.stats().orderBy("namespace").collect()]}

    def catalog(self, body: dict) -> dict:
        rows = {r["namespace"]: r["documents"] for r in self.engine.store.catalog().collect()}
        return {"total": rows.pop(None, 0), "namespaces": [{"namespace": n, "documents": c} for n, c in sorted(rows.items())]}

    def tenants(self, body: dict) -> dict:
        names = self.engine.store.tenants()
        return {"tenants": names, "count": len(names)}

    def tenant_shards(self, namespace: str, body: dict) -> dict:
        own = self.shards.list(namespace) if self.shards else []
        return {"tenant_id": namespace, "shards": own, "count": len(own)}

    def _context(self, namespace: str) -> tuple[pipeline.Context, list]:
        store = self.engine.store
        docs = store.view(namespace=namespace).select("id", "dense", "sparse", "text_fields", "payload")
        others = _Namespaces(lambda n: store.view(namespace=n).select("id", "dense", "payload"))
        return pipeline.start(docs, others=others, text_fields=self.engine.text_fields)

    def pipeline(self, body: dict):
        r = checked(body, PIPELINE)
        steps = [{"stage": s["stage_type"], "params": s.get("params", {})} for s in r["stages"]]
        for s in steps:
            if s["stage"] not in pipeline.STAGES:
                raise Refused(f"unknown stage {s['stage']!r}")
        ctx = self._context(r.get("namespace", "default"))
        if r.get("stream"):
            return self._events(pipeline.execute_streaming(steps, ctx))
        began = time.perf_counter()
        out = pipeline.execute(steps, ctx)
        return {"results": _rows(out.results), "metadata": _plain(out.metadata), "stages": out.stages, "latency_ms": (time.perf_counter() - began) * 1000}

    @staticmethod
    def _events(events: Iterator[dict]) -> Iterator[dict]:
        for e in events:
            yield {**e, "results": _rows(e["results"]), "metadata": _plain(e["metadata"])} if e["event"] == "done" else e

    def ingest(self, namespace: str, body: dict) -> dict:
        """One file, at once."""
        r = checked(body, INGEST)
        job = ingest.ingest(ingest.files(self.engine.spark, r["path"]), r["extractors"], self.engine.store, namespace)
        return job.snapshot()

    def ingest_batch(self, namespace: str, body: dict) -> dict:
        r = checked(body, INGEST)
        return self.jobs.submit(r["path"], r["extractors"], namespace).snapshot()

    def _job(self, job_id: str) -> ingest.Job:
        job = self.jobs.get(job_id)
        if job is None:
            raise KeyError(f"no job {job_id}")
        return job

    def job(self, job_id: str, body: dict) -> dict:
        return self._job(job_id).snapshot()

    def cancel(self, job_id: str, body: dict) -> dict:
        return {"cancelled": self._job(job_id).cancel()}


class _Namespaces(dict):
    """Documents of a namespace, looked up when they are needed."""

    def __init__(self, view: Callable):
        self._view = view

    def __missing__(self, name: str):
        self[name] = self._view(name)
        return self[name]


def _rows(results) -> list[dict]:
    """A pipeline's result list, which its search bounds, in order."""
    keep = [c for c in results.columns if c not in ("vector", "pos")]
    return [{k: json.loads(v) if k == "payload" and v else v for k, v in r.asDict().items()} for r in results.orderBy("pos").select(*keep).collect()]


def _plain(metadata: dict) -> dict:
    """Tables of the metadata, of a row a group or one in all, as lists."""
    return {k: [r.asDict() for r in v.collect()] if hasattr(v, "collect") else v for k, v in metadata.items()}


def serve(service: Service, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever() of it. Streamed pipelines are sent as server-sent events."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, out = service.handle(method, self.path.split("?")[0], json.loads(raw) if raw else None)
            except json.JSONDecodeError:
                status, out = 400, {"error": "the body isn't JSON"}
            kind = "text/plain" if isinstance(out, str) else "application/json" if isinstance(out, (dict, list)) else "text/event-stream"
            self.send_response(status)
            self.send_header("Content-Type", kind)
            if kind == "text/event-stream":
                self.end_headers()
                for e in out:
                    self.wfile.write(f"event: {e['event']}\ndata: {json.dumps(e)}\n\n".encode())
                return
            data = (out if isinstance(out, str) else json.dumps(out)).encode()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
