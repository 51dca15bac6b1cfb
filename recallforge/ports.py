"""Ports to models outside Spark: chat, embeddings, compression. Offline stubs are deterministic."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StructType

from recallforge.sources.shared import small_batches


class ChatPort(Protocol):
    def __call__(self, prompt: str) -> str: ...


class EmbedPort(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class CompressPort(Protocol):
    def __call__(self, text: str, rate: float) -> str: ...


def call_with_retries(call: Callable[[], str], tries: int = 5, accept: Callable[[str], bool] = bool, pause: Callable[[int], float] = lambda a: min(2.0 * a, 10.0), sleep=time.sleep) -> tuple[str, bool, str]:
    """(text, ok, error): tries again after errors and after answers that are not accepted; an error is forgotten once a try succeeds."""
    error = ""
    for attempt in range(1, tries + 1):
        try:
            text = call()
            if accept(text):
                return text, True, ""
            error = "answer not accepted"
        except Exception as e:  # the port decides what it raises
            error = f"{type(e).__name__}: {e}"
        if attempt < tries:
            sleep(pause(attempt))
    return "", False, error


def _also(rows: DataFrame, **columns: str | DataType) -> StructType:
    """Schema of ``rows`` and more columns; the one of ``rows`` itself stays as it is."""
    out = StructType(list(rows.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


#: Token counts that a chat answer may carry.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def deal(openers: list[Callable[[], ChatPort]]) -> Callable[[], ChatPort]:
    """One way to open a port out of several endpoints, dealt by partition."""

    def open_port() -> ChatPort:
        at = TaskContext.get()
        return openers[(at.partitionId() if at else 0) % len(openers)]()

    return open_port


def answering(port: ChatPort, tries: int = 5, accept: Callable[[str], bool] = bool, pause: Callable[[int], float] = lambda a: min(2.0 * a, 10.0)) -> Callable[[str], tuple]:
    """A function of a prompt: (response, ok, error, *the token counts of ``USAGE``) as ``port`` answers."""

    def one(p: str) -> tuple:
        spent = dict.fromkeys(USAGE, 0)

        def call() -> str:
            if not hasattr(port, "ask"):
                return port(p)
            text, usage = port.ask(p)
            spent.update({k: spent[k] + usage.get(k, 0) for k in USAGE})  # tries that were not accepted cost tokens too
            return text

        return (*call_with_retries(call, tries, accept, pause), *spent.values())

    return one


def chat(rows: DataFrame, open_port: Callable[[], ChatPort], prompt: str = "prompt", tries: int = 5, accept: Callable[[str], bool] = bool, pause: Callable[[int], float] = lambda a: min(2.0 * a, 10.0), parallel: int = 1) -> DataFrame:
    """Rows with response, ok, error, prompt_key (SHA-256 of the prompt) and the token counts of the answer (0 where the port tells none).

    One port a partition, at most ``parallel`` calls of it at a time; equal prompts of an Arrow batch are asked once. A port whose
    ``ask`` gives (text, usage) is asked by it, any other is called for the text. Lost executors repeat calls: a ``Ledger`` keeps answers and asks for new prompts only.
    """
    schema = _also(rows, response="string", ok="boolean", error="string", prompt_key="string", **dict.fromkeys(USAGE, "integer"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = answering(open_port(), tries, accept, pause)

        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for f in frames:
                asked = dict.fromkeys(f[prompt])
                got = dict(zip(asked, pool.map(one, asked), strict=True))
                answers = list(zip(*[got[p] for p in f[prompt]], strict=True)) or [[]] * 6
                keys = [hashlib.sha256((p or "").encode()).hexdigest() for p in f[prompt]]
                yield f.assign(response=list(answers[0]), ok=list(answers[1]), error=list(answers[2]), prompt_key=keys, **{u: list(a) for u, a in zip(USAGE, answers[3:], strict=True)})

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, open_port: Callable[[], EmbedPort], text: str = "text", unit: bool = True) -> DataFrame:
    """Rows with ``embedding`` (floats), a batch at a time; of length 1 if ``unit``, zero vectors stay."""
    schema = _also(rows, embedding=ArrayType(FloatType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = open_port()
        for f in frames:
            v = np.asarray(port([t or "" for t in f[text]]), dtype=np.float32)
            if unit and len(f):
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield f.assign(embedding=list(v))

    small_batches(rows.sparkSession)
    return rows.mapInPandas(run, schema)


def compress(rows: DataFrame, open_port: Callable[[], CompressPort], text: str = "content", rate: float = 0.8) -> DataFrame:
    """Rows with ``compressed``; blank texts stay, an empty answer gives the original."""
    schema = _also(rows, compressed="string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        port = open_port()
        for f in frames:
            yield f.assign(compressed=[t if not (t or "").strip() else port(t, rate) or t for t in f[text]])

    return rows.mapInPandas(run, schema)


def compress_offline(text: Column, keep: int = 5) -> Column:
    """Offline compression inside Spark: drops every ``keep``-th blank-parted word."""
    words = F.split(text, " ")
    return F.array_join(F.filter(words, lambda _, i: (i + 1) % keep != 0), " ")


class HashEmbedder:
    """Deterministic embedding of ``size`` from hashed tokens."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out


class TokenCountEmbedder:
    """Deterministic embedding of ``size`` whole numbers that SQL can express too: how many tokens fall in each bucket, by their length and their first and last characters."""

    def __init__(self, size: int = 32):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall("[a-z0-9]+", t.lower()):
                out[i, (7 * len(w) + 3 * ord(w[0]) + ord(w[-1])) % self.size] += 1
        return out


class HttpChat:
    """Chat over HTTP by the chat-completions protocol: POST <base>/chat/completions; ``ask`` gives the text and its token counts, and may be called from several threads. Parameters of None are not sent."""

    def __init__(self, base: str, model: str, key: str = "", timeout: float = 300.0, temperature: float | None = 0.0, top_p: float | None = None, max_tokens: int | None = None, open_url: Callable = urllib.request.urlopen):
        self.url, self.key, self.timeout, self.open_url = base.rstrip("/") + "/chat/completions", key, timeout, open_url
        self.body = {k: v for k, v in (("model", model), ("temperature", temperature), ("top_p", top_p), ("max_tokens", max_tokens)) if v is not None}
        self.usage: dict[str, int] = {}  # of the last call that was not an ``ask``

    def ask(self, prompt: str) -> tuple[str, dict[str, int]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        asked = urllib.request.Request(self.url, json.dumps(self.body | {"messages": [{"role": "user", "content": prompt}]}).encode(), head)
        with self.open_url(asked, timeout=self.timeout) as got:
            reply = json.loads(got.read())
        usage = {k: int((reply.get("usage") or {}).get(k) or 0) for k in USAGE}
        choices = reply.get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or "", usage

    def __call__(self, prompt: str) -> str:
        text, self.usage = self.ask(prompt)
        return text


class OnnxEmbedder:
    """Sentence vectors of an ONNX encoder: token states averaged under the mask, scaled to length 1. ``tokenizer`` and ``model`` are paths that every executor can read."""

    def __init__(self, model: str, tokenizer: str, max_tokens: int = 256, batch: int = 512, session: Callable | None = None, encode: Callable | None = None):
        if session is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        if encode is None:
            from tokenizers import Tokenizer

            reader = Tokenizer.from_file(tokenizer)
            reader.enable_truncation(max_tokens)
            reader.enable_padding()
            encode = lambda texts: [(e.ids, e.attention_mask) for e in reader.encode_batch(texts)]
        self.session, self.encode, self.batch = session, encode, batch

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = []
        names = {i.name for i in self.session.get_inputs()}
        for at in range(0, len(texts), self.batch):
            coded = self.encode(texts[at : at + self.batch])
            ids, mask = np.array([c[0] for c in coded], np.int64), np.array([c[1] for c in coded], np.int64)
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            states = self.session.run(None, {k: v for k, v in given.items() if k in names})[0]
            mean = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
            size = np.linalg.norm(mean, axis=1, keepdims=True)
            out.append(np.divide(mean, size, out=np.zeros_like(mean), where=size > 0).astype(np.float32))
        return np.concatenate(out) if out else np.zeros((0, 0), np.float32)


class EchoChat:
    """Answers every prompt with a fixed text or a function of the prompt; a prompt costs its characters, an answer its own."""

    def __init__(self, answer: str | Callable[[str], str]):
        self.answer = answer

    def ask(self, prompt: str) -> tuple[str, dict[str, int]]:
        text = self(prompt)
        return text, {"prompt_tokens": len(prompt or ""), "completion_tokens": len(text), "total_tokens": len(prompt or "") + len(text)}

    def __call__(self, prompt: str) -> str:
        return self.answer(prompt) if callable(self.answer) else self.answer
