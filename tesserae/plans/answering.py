"""Question to answer: rewrite, route, search each topic, merge, pack, generate with calculations, cite, log.

Everything that needs a model is a function that is passed in. Each has a deterministic default, so the whole path
runs without one. Failures of one topic, of the rewriter or of the router do not stop an answer.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from tesserae.config import DEFAULTS, Settings
from tesserae.functions.text import neutralised
from tesserae.operators.citations import Citations, build_citations
from tesserae.operators.retrieval import Context, IndexCache, build_context, hybrid_search, merge
from tesserae.operators.sync import ChunkStore, fingerprint, hashed_words
from tesserae.operators.table_query import TableRequest, TableResult, catalog_text, execute_requests
from tesserae.sources.tables import TableStore

REFUSAL = "I cannot answer this from the available documents."


@dataclass
class Topic:
    id: str
    name: str
    description: str = ""


@dataclass
class Generated:
    text: str
    answerable: bool = True
    used_chunks: list[int] = field(default_factory=list)
    used_calculations: list[int] = field(default_factory=list)
    requests: list[TableRequest] = field(default_factory=list)


@dataclass
class Usage:
    prompt_tokens: int = 0
    output_tokens: int = 0
    calls: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.prompt_tokens + other.prompt_tokens, self.output_tokens + other.output_tokens, self.calls + other.calls)


class Trace:
    """Steps of one question with their seconds and what they decided."""

    def __init__(self, question: str):
        self.question, self.steps, self.usage = question, [], Usage()

    @contextmanager
    def step(self, name: str):
        info: dict = {}
        began = time.perf_counter()
        try:
            yield info
        finally:
            self.steps.append({"name": name, "seconds": round(time.perf_counter() - began, 4), **info})

    def to_dict(self) -> dict:
        return {"question": self.question, "steps": self.steps, "usage": asdict(self.usage), "seconds": round(sum(s["seconds"] for s in self.steps), 4)}

    def __str__(self) -> str:
        return "\n".join(f"{s['name']:<10} {s['seconds']:7.3f} s  " + ", ".join(f"{k} {v}" for k, v in s.items() if k not in ("name", "seconds")) for s in self.steps)


class QueryLog:
    """One JSON line for each question; a log that cannot be written never breaks an answer."""

    def __init__(self, path: str):
        self.path = Path(path)

    def write(self, entry: dict) -> None:
        try:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(entry, ensure_ascii=False, default=str) + "\n")
        except OSError:
            pass


def with_retries(call: Callable, attempts: int = 6, first: float = 2.0, most: float = 60.0, transient: Callable[[Exception], bool] | None = None, sleep: Callable[[float], None] = time.sleep):
    """Calls again after transient failures, waiting twice as long each time."""
    transient = transient or (lambda e: isinstance(e, (ConnectionError, TimeoutError)) or getattr(e, "code", None) in (429, 500, 502, 503, 504))
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i + 1 == attempts or not transient(e):
                raise
            sleep(min(most, first * 2**i))


def history_text(history: Sequence[dict], settings: Settings = DEFAULTS) -> str:
    out = []
    for m in history[-settings.history_max_messages :]:
        said = " ".join(m["content"].split())
        said = said if len(said) <= settings.history_max_chars else said[: settings.history_max_chars] + "…"
        out.append(("User: " if m["role"] == "user" else "Assistant: ") + said)
    return "\n".join(out)


def rewrite_question(question: str, history: Sequence[dict], rewriter: Callable[[str, str], str] | None, settings: Settings = DEFAULTS) -> tuple[str, bool]:
    """A question that stands alone, and whether it was changed. Without history, or if rewriting fails, it stays as it is."""
    if not history or rewriter is None:
        return question, False
    try:
        new = (rewriter(question, history_text(history, settings)) or "").strip()
    except Exception:
        return question, False
    return (question, False) if not new or len(new) > settings.rewrite_max_chars else (new, new != question)


@dataclass
class Route:
    topics: list[str]
    dropped: list[str] = field(default_factory=list)
    fallback: bool = False


def route_question(question: str, topics: Sequence[Topic], router: Callable[[str], Sequence[str]] | None, settings: Settings = DEFAULTS) -> Route:
    """Up to router_max_topics known topics. A failure, or unknown topics only, means all; an empty choice means none."""
    known = [t.id for t in topics]
    if router is None:
        return Route(known)
    catalogue = "\n".join(f"- {t.id}: {t.name}. {t.description}" for t in topics)
    try:
        asked = list(dict.fromkeys(router(f"Topics:\n{catalogue}\n\nQuestion: {question}")))
    except Exception:
        return Route(known, fallback=True)
    good = [t for t in asked if t in known]
    if asked and not good:
        return Route(known, asked, True)
    return Route(good[: settings.router_max_topics], [t for t in asked if t not in known])


def build_prompt(question: str, context: Context, tables: str = "", calculations: Sequence[TableResult] = (), pictures: Sequence[str] = (), last: bool = False) -> str:
    parts = [f"<context>\n{context.text}\n</context>", f"The context has {len(context.items)} chunks."]
    parts += [f"Pictures: {', '.join(pictures)}"] * bool(pictures) + [f"Tables:\n{tables}"] * bool(tables)
    parts += ["Calculations:\n" + "\n".join(c.to_text() for c in calculations)] * bool(calculations)
    parts += ["No further calculations are possible: answer now."] * last
    return "\n\n".join([*parts, f"<question>\n{neutralised(question.strip())}\n</question>"])


def select_pictures(context: Context, readable: Callable[[str], bool] = lambda p: True, most: int = DEFAULTS.max_pictures) -> list[tuple[int, str]]:
    """(number, path) of the first pictures in rank order; each path is tried once."""
    seen, out = set(), []
    for item in context.items:
        path = item.get("image_path")
        if path and path not in seen and len(out) < most:
            seen.add(path)
            if readable(path):
                out.append((item["number"], path))
    return out


def generate(question: str, context: Context, generator: Callable[[str], Generated], tables: str, calculate: Callable[[list[TableRequest], int], list[TableResult]], settings: Settings = DEFAULTS, pictures: Sequence[str] = ()) -> tuple[Generated, list[TableResult], int]:
    """The answer, the calculations it asked for, and how often the generator was called."""
    if not context.items and not tables:
        return Generated(REFUSAL, False), [], 0
    done: list[TableResult] = []
    for i in range(settings.max_calc_rounds + 1):
        last = i == settings.max_calc_rounds
        got = generator(build_prompt(question, context, tables, done, pictures, last))
        if last or not got.requests:
            break
        done += calculate(got.requests, len(done) + 1)
    if not got.answerable:
        text = got.text if got.text.startswith(REFUSAL) else f"{REFUSAL} {got.text}".strip()
        got = Generated(text, False)
    return got, done, i + 1


def first_sentences(prompt: str) -> Generated:
    """The default generator: quotes the best chunk."""
    m = re.search(r"<context>\n\[1\][^\n]*\n(.*?)(?:\n-----\n|\n</context>)", prompt, re.DOTALL)
    return Generated(f"{m[1].strip()[:300]} [1]", True, [1]) if m else Generated("", False)


@dataclass
class Answer:
    status: str
    text: str
    question: str
    route: Route | None = None
    context: Context | None = None
    citations: Citations | None = None
    calculations: list[TableResult] = field(default_factory=list)
    trace: Trace | None = None

    def to_dict(self) -> dict:
        return {"status": self.status, "text": self.text, "question": self.question, "topics": self.route.topics if self.route else [], "calculations": [c.to_dict() for c in self.calculations], "trace": self.trace.to_dict() if self.trace else None}


class Answering:
    """Answers questions over a chunk store and a table store."""

    def __init__(self, spark: SparkSession, topics: Sequence[Topic], chunks: ChunkStore, tables: TableStore | None = None, embed_query: Callable[[str], list[float]] | None = None, rewriter=None, router=None, generator: Callable[[str], Generated] = first_sentences, log: QueryLog | None = None, settings: Settings = DEFAULTS, max_distance: float | None = None, search: Callable | None = None):
        self.spark, self.topics, self.chunks, self.tables = spark, list(topics), chunks, tables
        self.embed_query = embed_query or (lambda q: hashed_words([q])[0])
        self.rewriter, self.router, self.generator, self.log = rewriter, router, generator, log
        self.settings, self.max_distance = settings, max_distance
        self.search, self.indexes = search or self._search, IndexCache()

    def _search(self, topic: str, question: str, vector: list[float]) -> list[dict]:
        rows = self.chunks.chunks(topic)
        if rows is None:
            return []
        index = self.indexes.get(topic, fingerprint(rows), rows)
        return [r.asDict() for r in hybrid_search(rows, index, question, vector, self.settings.top_k).collect()]

    def answer(self, question: str, history: Sequence[dict] = ()) -> Answer:
        trace = Trace(question)
        try:
            out = self._run(question, history, trace)
        except Exception as e:
            out = Answer("error", f"Something went wrong: {type(e).__name__}: {e}", question)
        out.trace = trace
        if self.log:
            self.log.write(out.to_dict())
        return out

    def _run(self, question: str, history: Sequence[dict], trace: Trace) -> Answer:
        question = question.strip()
        if not question:
            return Answer("input", "Please ask a question.", question)
        if len(question) > self.settings.question_max_chars:
            return Answer("input", f"The question is longer than {self.settings.question_max_chars:,} characters.", question)
        with trace.step("rewrite") as info:
            question, info["changed"] = rewrite_question(question, history, self.rewriter, self.settings)
        with trace.step("route") as info:
            route = route_question(question, self.topics, self.router, self.settings)
            info["topics"] = route.topics
        if not route.topics:
            return Answer("router", REFUSAL, question, route)
        with trace.step("embed"):
            vector = self.embed_query(question)
        hits, broken = {}, {}
        for t in route.topics:
            with trace.step("search") as info:
                info["topic"] = t
                try:
                    hits[t] = self.search(t, question, vector)
                except Exception as e:
                    broken[t] = info["error"] = f"{type(e).__name__}: {e}"
        if not hits:
            raise RuntimeError("no topic could be searched: " + "; ".join(broken.values()))
        with trace.step("merge") as info:
            merged = merge(hits, self.settings.top_k, self.max_distance, self.settings)
            info |= {"candidates": merged.candidates, "duplicates": len(merged.duplicates), "too_far": merged.too_far}
        catalog = self.tables.catalog(route.topics) if self.tables else []
        if not merged.hits and not catalog:
            return Answer("retrieval", REFUSAL, question, route)
        with trace.step("context") as info:
            context = build_context(SparkSession.active(), merged.hits, self.settings.context_max_tokens, self.settings)
            info |= {"items": len(context.items), "tokens": context.tokens, "dropped": len(context.dropped)}
        with trace.step("generate") as info:
            calculate = lambda reqs, start: execute_requests(reqs, catalog, self.tables.load, start, self.settings)
            got, done, info["calls"] = generate(question, context, self.generator, catalog_text(catalog, self.settings), calculate, self.settings, [p for _, p in select_pictures(context)])
            info["calculations"] = len(done)
        cited = build_citations(got.text, got.answerable, got.used_chunks, got.used_calculations, context.items, done)
        return Answer("answered" if got.answerable else "refused", cited.text, question, route, context, cited, done)


def jittered(seconds: float, seed: int | None = None) -> float:
    """A wait of up to a tenth more, so that many callers do not come back at once."""
    return seconds * (1 + random.Random(seed).random() / 10)
