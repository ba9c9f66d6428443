"""Batch inference over a prompt table (I1), retry policy (I2) and backend
routing (I3).

The model call is the caller's: a *backend* maps an ``api`` name to a
factory ``make_client(model: dict) -> call(prompt: str) -> str``. Clients are
built once per partition and model. Every failure becomes a row
(``error=True`` + message), never a task failure, so a retried task only
repeats calls (keep speculation off for these stages; ids are idempotent).

A call may have a deadline: it runs in a thread of its own, and a call that
has not answered in time is given up and becomes an error row. A task keeps at
most ``in_flight`` calls open. Each row carries the time its call ended.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..constants import CALL_ERROR_CHARS, RETRY_ATTEMPTS, RETRY_DELAY_SEC

Call = Callable[[str], str]
Backend = Callable[[dict], Call]

RESULT_FIELDS = [
    T.StructField("text", T.StringType()),
    T.StructField("elapsed", T.DoubleType()),
    T.StructField("error", T.BooleanType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("called_at", T.TimestampType()),
]
NOT_CALLED = "not called after: "  # how the message of a prompt begins that was left out after a halt
_RESULT_ARROW = [pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.timestamp("us", tz="UTC")]


def with_deadline(call: Call, seconds: float | None) -> Call:
    """``call`` that raises TimeoutError when it has no answer after ``seconds`` (its thread is left behind)."""
    if seconds is None:
        return call

    def timed(prompt: str) -> str:
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def work() -> None:
            try:
                answer.put((True, call(prompt)))
            except BaseException as exc:  # noqa: BLE001 - handed to the caller
                answer.put((False, exc))
        threading.Thread(target=work, daemon=True).start()
        try:
            ok, value = answer.get(timeout=seconds)
        except queue.Empty:
            raise TimeoutError(f"no answer within {seconds:g} s") from None
        if not ok:
            raise value
        return value
    return timed


def with_retry(call: Call, attempts: int = RETRY_ATTEMPTS, delay: float = RETRY_DELAY_SEC,
               sleep: Callable[[float], None] = time.sleep) -> Call:
    """Try ``attempts`` times, ``delay`` seconds apart; the last
    exception propagates (``infer`` turns it into an error row)."""
    def wrapped(prompt: str) -> str:
        for i in range(1, attempts + 1):
            try:
                return call(prompt)
            except Exception:  # noqa: BLE001 - any backend failure is retried
                if i == attempts:
                    raise
                sleep(delay)
        raise RuntimeError("unreachable")
    return wrapped


class _Caller:
    """The calls of one task: clients by model, results as rows."""

    def __init__(self, backends, keys, api_key, attempts, delay, deadline, error_prefix, error_chars, halt_markers):
        self.backends, self.keys, self.api_key = backends, keys, api_key
        self.attempts, self.delay, self.deadline = attempts, delay, deadline
        self.prefix, self.chars, self.markers = error_prefix, error_chars, halt_markers
        self.clients: dict = {}
        self.halted: dict = {}
        self.lock = threading.Lock()

    def client(self, model: dict, api) -> Call:
        key = (api, model.get("model_name"), model.get("model_id"))
        with self.lock:
            if key not in self.clients:
                call = with_deadline(self.backends[api](model), self.deadline)
                self.clients[key] = with_retry(call, self.attempts, self.delay) if self.attempts > 1 else call
            return self.clients[key]

    def __call__(self, row: tuple) -> tuple:
        *values, prompt = row
        model = dict(zip(self.keys, values))
        api, name, began = model.get(self.api_key), model.get("model_name"), time.time()
        try:
            if api not in self.backends:
                raise LookupError(f"no backend for api '{api}'")
            if name in self.halted:
                raise RuntimeError(NOT_CALLED + self.halted[name])
            text = self.client(model, api)(prompt or "")
            result = ("" if text is None else str(text), False, "")
        except Exception as exc:  # noqa: BLE001 - failures are data
            message = (self.prefix + str(exc))[:self.chars + len(self.prefix)]
            if any(m in message.lower() for m in self.markers):
                self.halted.setdefault(name, message)
            result = ("", True, message)
        text, error, message = result
        return text, time.time() - began, error, message, datetime.now(timezone.utc)


def infer(df: DataFrame, backends: dict[str, Backend], prompt_col: str = "prompt",
          model_cols: tuple[str, ...] = ("model_name", "api", "model_id", "temperature", "max_tokens"),
          attempts: int = 1, delay: float = RETRY_DELAY_SEC, error_chars: int = CALL_ERROR_CHARS,
          error_prefix: str = "", out_prefix: str = "", api_col: str = "api", deadline: float | None = None,
          in_flight: int = 1, partitions: int | None = None, halt_markers: tuple[str, ...] = (),
          model_keys: dict[str, str] | None = None) -> DataFrame:
    """I1 + I3: append (text, elapsed, error, error_message, called_at) to every row
    (names prefixed with ``out_prefix``).

    The backend's factory is given the ``model_cols`` that are present, by
    their own names or those in ``model_keys``. Rows whose ``api`` has no
    backend get an error row naming it (I3). ``partitions`` deals the rows out
    over so many tasks first; ``deadline`` is seconds for each attempt. After
    an error whose message has one of ``halt_markers``, a task calls that
    model no more: its later rows are errors that say so."""
    if partitions:
        df = df.repartition(partitions)
    names = model_keys or {}
    present = [c for c in dict.fromkeys([*model_cols, api_col]) if c in df.columns]
    keys, api_key = [names.get(c, c) for c in present], names.get(api_col, api_col)
    fields = [T.StructField(out_prefix + f.name, f.dataType) for f in RESULT_FIELDS]
    schema = T.StructType(df.schema.fields + fields)

    def run(batches):
        one = _Caller(backends, keys, api_key, attempts, delay, deadline, error_prefix, error_chars, halt_markers)
        pool = ThreadPoolExecutor(in_flight) if in_flight > 1 else None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in (*present, prompt_col)])
            results = list(pool.map(one, rows) if pool else map(one, rows))
            added = [pa.array([r[k] for r in results], t) for k, t in enumerate(_RESULT_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema)
