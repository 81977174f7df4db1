"""A plugin process kept by each worker: JSON lines to its input and from its output, ended when it hangs, dies or idles."""

from __future__ import annotations

import atexit
import json
import os
import selectors
import subprocess
import sys
import threading
import time
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TIMEOUT = 600.0
IDLE = 900.0
PROTOCOL = "textloom-plugin.v1"


class PluginError(Exception):
    """The plugin hung, died or answered with something else than a result."""


class Plugin:
    """One process, started at the first call and again after a fault or an idle stop; calls wait for each other."""

    def __init__(self, command: list[str], timeout: float = TIMEOUT, idle: float = IDLE, protocol: str = PROTOCOL):
        self.command, self.timeout, self.idle, self.protocol = command, timeout, idle, protocol
        self.process, self.rest, self.used, self.starts = None, b"", 0.0, 0
        self.lock = threading.RLock()
        atexit.register(self.stop)

    def _start(self) -> None:
        self.process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0)
        self.rest, self.starts = b"", self.starts + 1
        if self.idle > 0:
            threading.Thread(target=self._watch, args=(self.process,), daemon=True).start()

    def _watch(self, process) -> None:
        while process.poll() is None:
            left = self.used + self.idle - time.monotonic()
            if left <= 0 and self.lock.acquire(blocking=False):
                try:
                    if self.process is process and self.used + self.idle <= time.monotonic():
                        self.stop()
                        return
                finally:
                    self.lock.release()
            time.sleep(min(1.0, max(0.05, left)))

    def stop(self) -> None:
        with self.lock:
            if self.process is not None:
                self.process.kill()
                self.process.wait()
                for pipe in (self.process.stdin, self.process.stdout):
                    pipe.close()
                self.process = None

    def _line(self, deadline: float) -> bytes:
        """The next line that is not blank; reads what there is, so that half a line does not block past the deadline."""
        with selectors.DefaultSelector() as ready:
            ready.register(self.process.stdout, selectors.EVENT_READ)
            while True:
                line, mark, rest = self.rest.partition(b"\n")
                if mark:
                    self.rest = rest
                    if line.strip():
                        return line
                    continue
                if not ready.select(max(0.0, deadline - time.monotonic())):
                    raise PluginError("timed out")
                got = os.read(self.process.stdout.fileno(), 1 << 16)
                if not got:
                    raise PluginError("the process ended")
                self.rest += got

    def call(self, capability: str, payload: dict) -> dict:
        """The plugin's output for a payload; any fault ends the process, so that the next call starts another."""
        request = json.dumps({"protocol": self.protocol, "capability": capability, "payload": payload}).encode() + b"\n"
        with self.lock:
            self.used = time.monotonic()
            try:
                if self.process is None or self.process.poll() is not None:
                    self.stop()
                    self._start()
                deadline = time.monotonic() + self.timeout
                writer = threading.Thread(target=self._write, args=(self.process.stdin, request), daemon=True)
                writer.start()  # a process that does not read must not block the call past the deadline
                answer = json.loads(self._line(deadline))
                self.used = time.monotonic()
            except (OSError, ValueError, PluginError) as e:
                self.stop()
                raise PluginError(f"{self.command[0]}: {e}") from e
        if not isinstance(answer, dict) or answer.get("type") == "error" or not isinstance(answer.get("output"), dict):
            raise PluginError(f"{self.command[0]}: {str(answer.get('error', 'no output') if isinstance(answer, dict) else answer)[-300:]}")
        return answer["output"]

    @staticmethod
    def _write(pipe, request: bytes) -> None:
        try:
            pipe.write(request)
        except (OSError, ValueError):
            return  # the reader sees the end of the process


def apply(df: DataFrame, command: list[str], capability: str, text: str, out: str, field: str, kind: str, timeout: float = TIMEOUT, idle: float = IDLE, tries: int = 2) -> DataFrame:
    """df with ``out``, field ``field`` of the plugin's output for each row's text (null counts as empty), and ``out``_error, the
    fault of a row that the plugin failed ``tries`` times; other rows go on.

    Each Python worker keeps one process for a command across batches and tasks; ``command`` must be there on every executor.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}, `{out}_error` string"
    key = ("plugin", *command, timeout, idle)

    def run(batches: Iterator[pd.DataFrame]):
        kept = sys.modules.setdefault("textloom_plugins", types.ModuleType("textloom_plugins")).__dict__
        plugin = kept.get(key) or kept.setdefault(key, Plugin(command, timeout, idle))

        def one(t):
            for left in range(tries - 1, -1, -1):
                try:
                    return plugin.call(capability, {"text": t or ""}).get(field), None
                except PluginError as e:
                    if not left:
                        return None, str(e)

        for pdf in batches:
            got = [one(t) for t in pdf[text]]
            yield pdf.assign(**{out: [v for v, _ in got], f"{out}_error": [e for _, e in got]})

    return df.mapInPandas(run, schema)
