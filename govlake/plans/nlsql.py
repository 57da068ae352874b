"""Questions to SQL: generator interface, clean-up of replies, retries with the error, session states."""

from __future__ import annotations

import json
import os
import re
import subprocess
import textwrap
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from govlake.functions.scalars import value_text
from govlake.plans.sqlgate import Gate, Rejected

#: Words a reply may begin with to count as a query; the gate runs all of these.
QUERY_WORDS = ("SELECT", "WITH", "FROM", "VALUES", "DESCRIBE", "EXPLAIN")
MOST_TRIES = 3
#: Seconds that a back-end may take.
PATIENCE = 300

PROMPT = textwrap.dedent("""\
    You write one Spark SQL query that answers a question about the tables below.
    Qualify tables as dataset.table. Show names, not ids. Values are lower case.
    Use only the columns listed. Filter large tables on their partition columns.
    Money: brl(x). Aggregate before joining. Reply with SQL only, or {"error": "..."}.
    """)


class Generator(Protocol):
    def generate(self, question: str, schema: str, prompt: str) -> str: ...


@dataclass
class CallableGenerator:
    """Any function (question, schema, prompt) -> reply as a generator; back-ends inject theirs."""

    call: Callable[[str, str, str], str]

    def generate(self, question: str, schema: str, prompt: str) -> str:
        return self.call(question, schema, prompt)


@dataclass
class CommandGenerator:
    """A command that reads the whole prompt from its standard input and writes the reply."""

    command: list[str]
    patience: float = PATIENCE

    def generate(self, question: str, schema: str, prompt: str) -> str:
        done = subprocess.run(self.command, input=f"{prompt.strip()}\n\n{schema}\n\nQuestion: {question}\n\nSQL:", capture_output=True, text=True, timeout=self.patience, check=False)
        if done.returncode:
            raise RuntimeError(f"{self.command[0]} failed: {done.stderr.strip()}")
        return done.stdout


@dataclass
class HttpGenerator:
    """A JSON service: ``body`` makes the request from (system text, question), ``path`` leads to the reply's text."""

    url: str
    body: Callable[[str, str], dict]
    path: tuple[str | int, ...]
    headers: dict[str, str] = field(default_factory=dict)
    patience: float = PATIENCE

    def generate(self, question: str, schema: str, prompt: str) -> str:
        data = json.dumps(self.body(f"{prompt.strip()}\n\nSchema:\n\n{schema}", question)).encode()
        request = urllib.request.Request(self.url, data=data, headers={"Content-Type": "application/json", **self.headers}, method="POST")
        with urllib.request.urlopen(request, timeout=self.patience) as reply:
            found = json.loads(reply.read())
        for key in self.path:
            found = found[key]
        return strip_fences(str(found))


def contents_generator(base: str, model: str, key: str) -> HttpGenerator:
    """Services that take ``contents`` of parts, with the system text apart."""
    body = lambda system, question: {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"parts": [{"text": question}]}]}
    return HttpGenerator(f"{base}/models/{model}:generateContent", body, ("candidates", 0, "content", "parts", 0, "text"), {"X-goog-api-key": key})


def chat_generator(base: str, model: str, key: str) -> HttpGenerator:
    """Services that take chat messages."""
    body = lambda system, question: {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": question}]}
    return HttpGenerator(f"{base}/chat/completions", body, ("choices", 0, "message", "content"), {"Authorization": f"Bearer {key}"})


def completion_generator(base: str, model: str) -> HttpGenerator:
    """Local services that complete one prompt."""
    body = lambda system, question: {"model": model, "prompt": f"{system}\n\nQuestion: {question}\n\nSQL:", "stream": False}
    return HttpGenerator(f"{base}/api/generate", body, ("response",))


def generator_from_environment(env: dict[str, str] | None = None) -> Generator:
    """The back-end that ``SQL_GENERATOR`` names; addresses, models and keys come from the environment too, nothing is built in."""
    env = dict(os.environ) if env is None else env
    kind = env.get("SQL_GENERATOR", "contents")
    made = {"contents": contents_generator, "chat": chat_generator, "completion": completion_generator}
    if kind == "command":
        return CommandGenerator(env["SQL_GENERATOR_COMMAND"].split())
    if kind not in made:
        raise ValueError(f"unknown SQL_GENERATOR {kind}; known: command, {', '.join(made)}")
    given = [env["SQL_GENERATOR_URL"].rstrip("/"), env["SQL_GENERATOR_MODEL"]]
    return made[kind](*given, *([] if kind == "completion" else [env["SQL_GENERATOR_KEY"]]))


def strip_thinking(text: str) -> str:
    return re.sub(r"<think(?:ing)?>.*?</think(?:ing)?>", "\n", text, flags=re.S).strip()


def strip_fences(text: str) -> str:
    """The content of the first code fence, if there is one; without a last semicolon."""
    found = re.search(r"```(?:sql\b)?[ \t]*\n?(.*?)(?:```|\Z)", text, flags=re.S | re.I)
    return (found[1] if found else text).strip().rstrip(";").strip()


def clean_sql(reply: str) -> str:
    return strip_fences(strip_thinking(reply))


def ensure_sql(text: str) -> str:
    """Queries pass; any other text becomes a query that returns it."""
    first = re.match(r"[A-Za-z]+", text.lstrip("( \n\t"))
    if first and first[0].upper() in QUERY_WORDS:
        return text
    quoted = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"SELECT '{quoted}' AS resposta"


def wrap_words(text: str, width: int) -> list[str]:
    """Greedy wrapping; blank paragraphs stay."""
    return [line for p in text.split("\n") for line in (textwrap.wrap(p, width, break_long_words=False) or [""])]


def duration(seconds: float) -> str:
    return f"{int(seconds) // 60}m {int(seconds) % 60}s" if seconds >= 60 else f"{seconds:.2f}s"


def stringify(df: DataFrame) -> DataFrame:
    """Every value as text, as result tables show it."""
    return df.select(*[value_text(f.name, f.dataType.simpleString()).alias(f.name) for f in df.schema])


class State(Enum):
    INPUT = "input"
    GENERATING = "generating"
    RUNNING = "running"
    RETRYING = "retrying"
    DONE = "done"
    ERROR = "error"


class Event(Enum):
    ASKED = "asked"
    GENERATED = "generated"
    SUCCEEDED = "succeeded"
    FAILED = "failed"
    RESET = "reset"


def step(state: State, event: Event, tries: int = 0, most: int = MOST_TRIES) -> State:
    """The next state of an interaction."""
    if event is Event.RESET:
        return State.INPUT
    table = {
        (State.INPUT, Event.ASKED): State.GENERATING,
        (State.GENERATING, Event.GENERATED): State.RUNNING,
        (State.RETRYING, Event.GENERATED): State.RUNNING,
        (State.RUNNING, Event.SUCCEEDED): State.DONE,
        (State.GENERATING, Event.FAILED): State.ERROR,
        (State.RETRYING, Event.FAILED): State.ERROR,
    }
    if (state, event) == (State.RUNNING, Event.FAILED):
        return State.RETRYING if tries < most else State.ERROR
    return table.get((state, event), state)


@dataclass
class Answer:
    sql: str
    df: DataFrame | None
    error: str | None
    tries: int


@dataclass
class Asker:
    """Asks a generator, runs its query through the gate, and hands errors back up to ``most`` times."""

    gate: Gate
    generator: Generator
    schema: Callable[[str], str]
    log: Callable[[str, str, bool, str | None], None] | None = None
    most: int = MOST_TRIES
    states: list[State] = field(default_factory=list)

    def ask(self, question: str) -> Answer:
        schema, asked, state = self.schema(question), question, step(State.INPUT, Event.ASKED)
        self.states = [state]
        tries, sql, error = 0, "", None
        while state not in (State.DONE, State.ERROR):
            if state in (State.GENERATING, State.RETRYING):
                sql = ensure_sql(clean_sql(self.generator.generate(asked, schema, PROMPT)))
                state = step(state, Event.GENERATED)
            else:
                try:
                    df = self.gate.run(sql)
                    df.schema  # analysis only: no job yet
                    df.limit(1).collect()
                    state, error = step(state, Event.SUCCEEDED), None
                except (Rejected, Exception) as e:  # the generator gets any kind of error back
                    error = str(e).splitlines()[0]
                    state = step(state, Event.FAILED, tries, self.most)
                    tries += 1
                    asked = f"{question}\n\nThis query failed:\n{sql}\n\nError: {error}\nWrite a corrected query."
            self.states.append(state)
        if self.log:
            self.log(question, sql, error is None, error)
        return Answer(sql, df if error is None else None, error, tries)


LOG = "timestamp string, question string, sql string, success boolean, error string"


def table_log(spark: SparkSession, path: str) -> Callable[[str, str, bool, str | None], None]:
    """An append-only Parquet log of questions."""

    def write(question: str, sql: str, success: bool, error: str | None) -> None:
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        spark.createDataFrame([(now, question, sql, success, error)], LOG).coalesce(1).write.mode("append").parquet(path)

    return write
