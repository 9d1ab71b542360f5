"""Fetching pages over HTTP as a stage of its own: requests in, responses out, errors as columns.

Extraction never fetches; a program runs over what this stage has stored, as often as wanted.
"""

from __future__ import annotations

import functools
import http.client
import socket
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import Program
from webloom.sources.urls import public_address, public_internet

SCHEMA = "url string, status int, content_type string, body binary, code string, message string"


@dataclass(frozen=True)
class Session:
    headers: dict[str, str] = field(default_factory=dict)
    cookies: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Options:
    timeout: float = 30.0
    max_bytes: int = 32 << 20
    user_agent: str = "webloom"
    policy: Callable[[str], str | None] | None = public_internet
    #: Asked about every address that a host's name has, and about the one that is connected to; None without ``policy``.
    address_policy: Callable[[str], str | None] | None = public_address


def guarded_connection(address_policy: Callable[[str], str | None], address: tuple[str, int], timeout: float | None = None, source_address: tuple[str, int] | None = None, **_) -> socket.socket:
    """A connection to one of the host's addresses, all of which are checked first: the name isn't resolved again between
    the check and the connection."""
    host, port = address
    found = socket.getaddrinfo(host, port, 0, socket.SOCK_STREAM)
    for *_ignored, (ip, *_rest) in found:
        why = address_policy(ip)
        if why:
            raise ExecutionError("E_URL_POLICY", f"{host} is {ip}: {why}")
    last: OSError = OSError(f"{host} has no address")
    for family, kind, protocol, _name, target in found:
        s = socket.socket(family, kind, protocol)
        try:
            if isinstance(timeout, (int, float)):
                s.settimeout(timeout)
            if source_address:
                s.bind(source_address)
            s.connect(target)
            return s
        except OSError as e:
            s.close()
            last = e
    raise last


def _guarded(kind: type, connect: Callable) -> Callable:
    def make(host, **options):
        connection = kind(host, **options)
        connection._create_connection = connect
        return connection

    return make


class _Http(urllib.request.HTTPHandler):
    def __init__(self, connect):
        super().__init__()
        self.connect = connect

    def http_open(self, req):
        return self.do_open(_guarded(http.client.HTTPConnection, self.connect), req)


class _Https(urllib.request.HTTPSHandler):
    def __init__(self, connect):
        super().__init__()
        self.connect = connect

    def https_open(self, req):
        return self.do_open(_guarded(http.client.HTTPSConnection, self.connect), req, context=self._context)


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, policy):
        self.policy = policy

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        why = self.policy(newurl)
        if why:
            raise ExecutionError("E_URL_POLICY", why)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def session_for(program: Program, session: Session | None) -> Session | None:
    """The session that the program's policy lets through."""
    if program.session == "none":
        return None
    if program.session == "required" and session is None:
        raise ExecutionError("E_SESSION_REQUIRED", "the program requires a session", "source.session")
    return session


def fetch_one(url: str, session: Session | None = None, options: Options = Options(), opener=None) -> dict:
    """One response; raises ``ExecutionError``."""
    why = options.policy(url) if options.policy else None
    if why:
        raise ExecutionError("E_URL_POLICY", why, "source.fetch.url")
    headers = {"User-Agent": options.user_agent}
    if session:
        headers |= dict(sorted(session.headers.items()))
        if session.cookies:
            headers["Cookie"] = "; ".join(f"{k}={v}" for k, v in session.cookies.items())
    if opener is None:
        handlers = [urllib.request.ProxyHandler({}), _Redirects(options.policy or (lambda _: None))]
        if options.policy and options.address_policy:
            connect = functools.partial(guarded_connection, options.address_policy)
            handlers += [_Http(connect), _Https(connect)]
        opener = urllib.request.build_opener(*handlers)
    try:
        request = urllib.request.Request(url, headers=headers)
    except ValueError as e:
        raise ExecutionError("E_HTTP_REQUEST", str(e)) from None
    try:
        response = opener.open(request, timeout=options.timeout)
    except urllib.error.HTTPError as e:
        raise ExecutionError("E_HTTP_STATUS", f"status {e.code}") from None
    except OSError as e:
        raise ExecutionError("E_HTTP_FETCH", str(e)) from None
    with response:
        if not 200 <= response.status < 300:
            raise ExecutionError("E_HTTP_STATUS", f"status {response.status}")
        try:
            body = response.read(options.max_bytes + 1)
        except OSError as e:
            raise ExecutionError("E_HTTP_READ", str(e)) from None
        if len(body) > options.max_bytes:
            raise ExecutionError("E_HTTP_BODY_TOO_LARGE", f"body exceeds {options.max_bytes} bytes")
        return {"status": response.status, "content_type": response.headers.get("Content-Type"), "body": body}


def fetch(requests: DataFrame, url: str = "url", *, keep: tuple[str, ...] = (), session: Session | None = None, options: Options = Options(), fetcher: Callable = fetch_one) -> DataFrame:
    """``keep``'s columns and (url, status, content_type, body, code, message), one row for every row that has a URL, equal
    ones too; an error fills code and message. A kept column with a result's name is refused."""
    kept = list(dict.fromkeys(keep))
    results = pa.schema([("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("code", pa.string()), ("message", pa.string())])
    twice = [c for c in kept if c.lower() in results.names]
    if twice:
        raise ValueError(f"kept columns have names of results, rename them first: {', '.join(twice)}")

    def run(batches):
        for batch in batches:
            for i, u in enumerate(batch.column(len(kept)).to_pylist()):
                row = {"url": u, "status": None, "content_type": None, "body": None, "code": None, "message": None}
                try:
                    row |= fetcher(u, session, options)
                except ExecutionError as e:
                    row |= {"code": e.code, "message": e.message}
                got = pa.RecordBatch.from_pylist([row], schema=results)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[: len(kept)], *got.columns], names=[*kept, *results.names])

    asked = requests.where(F.col(f"`{url}`").isNotNull()).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{url}`").alias("url"))
    return asked.mapInArrow(run, T.StructType([*asked.schema.fields[: len(kept)], *T.StructType.fromDDL(SCHEMA).fields]))
