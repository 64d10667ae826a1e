"""HTTP scoring: GET /healthz, POST /v1/score with manifest, ground_truth and predictions as JSON members.

A thin WSGI application on the standard library; scoring itself is score_files on the session. Each file may have
128 MiB (else 413); what breaks a contract is answered with 422.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from email.parser import BytesParser
from email.policy import HTTP

from pyspark.sql import SparkSession

from .plans.report import score_files
from .session import discard, put, shared_dir
from .sources.contracts import ContractError

MAX_BYTES = 128 * 1024 * 1024
PARTS = ("manifest", "ground_truth", "predictions")


def _multipart(content_type: str, body: bytes) -> dict[str, bytes]:
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body)
    return {p.get_param("name", header="content-disposition"): p.get_payload(decode=True) for p in message.iter_parts()}


def application(spark: SparkSession) -> Callable:
    def app(environ: dict, start_response: Callable) -> Iterable[bytes]:
        def answer(status: str, value: dict) -> list[bytes]:
            start_response(status, [("Content-Type", "application/json; charset=utf-8")])
            return [json.dumps(value, ensure_ascii=False).encode()]

        route = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "")
        if route == ("GET", "/healthz"):
            return answer("200 OK", {"status": "ok"})
        if route != ("POST", "/v1/score"):
            return answer("404 Not Found", {"detail": "no such route"})
        size = int(environ.get("CONTENT_LENGTH") or 0)
        if size > len(PARTS) * MAX_BYTES + 65_536:
            return answer("413 Content Too Large", {"detail": "upload over the limit"})
        files = _multipart(environ.get("CONTENT_TYPE", ""), environ["wsgi.input"].read(size))
        if any(p not in files for p in PARTS):
            return answer("422 Unprocessable Content", {"detail": f"parts needed: {', '.join(PARTS)}"})
        if any(len(files[p]) > MAX_BYTES for p in PARTS):
            return answer("413 Content Too Large", {"detail": "upload over the limit"})
        folder = f"{shared_dir(spark)}/uploads/{uuid.uuid4().hex}"  # executors read it, too
        try:
            for p in PARTS:
                put(spark, f"{folder}/{p}.json", files[p])
            return answer("200 OK", score_files(spark, *(f"{folder}/{p}.json" for p in PARTS)))
        except ContractError as e:
            return answer("422 Unprocessable Content", {"detail": str(e)})
        finally:
            discard(spark, folder)

    return app


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8001) -> None:
    from wsgiref.simple_server import make_server

    make_server(host, port, application(spark)).serve_forever()
