"""Language-model providers over HTTP, for sessions that have one (AGT-11, AGT-12), and the prompts they get (AGT-13)."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from lavra.plans.agent import Step, StepResult, json_object, parse_plan

Opener = Callable[[urllib.request.Request, float], bytes]

PLAN_PROMPT = 'Divida a pergunta em passos sobre as fontes dadas. Responda só com JSON: {"steps": [{"id": 1, "description": "", "source_id": "", "source_type": "sql|api|spreadsheets", "operation": "filter|aggregation|lookup|comparison|list", "depends_on": []}]}'
SQL_PROMPT = "Escreva uma única consulta SQL de leitura para o passo dado. Use só as tabelas e colunas descritas. Em comparações, diferença = existente - previsto; valor negativo é déficit. Responda só com a consulta."
ANSWER_PROMPT = "Responda à pergunta só com os resultados dados e diga de que fontes vieram. Se um passo falhou, diga que falta essa parte."


def _open(request: urllib.request.Request, timeout: float) -> bytes:
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read()


@dataclass
class HttpProvider:
    """A chat endpoint: `ollama` (local), `azure` or `gemini` (key from options or environment)."""

    kind: str
    url: str
    model: str
    key: str | None = None
    timeout: float = 120.0
    tries: int = 3
    pause: float = 2.0
    opener: Opener = _open

    def __post_init__(self):
        if self.kind not in ("ollama", "azure", "gemini"):
            raise ValueError(f"unknown provider {self.kind}")
        names = {"azure": ("AZURE_OPENAI_API_KEY", "AZURE_OPENAI_KEY"), "gemini": ("GOOGLE_API_KEY",)}.get(self.kind, ())
        if names and self.key is None:
            self.key = next((os.environ[n] for n in names if os.environ.get(n)), None)
        if self.kind == "gemini" and not self.key:
            raise ValueError("GOOGLE_API_KEY is not set")
        self.tokens = 0

    def _request(self, system: str, user: str, schema: dict | None) -> urllib.request.Request:
        headers = {"Content-Type": "application/json"}
        if self.kind == "gemini":
            body: dict = {"contents": [{"parts": [{"text": f"{system}\n\n{user}" if system else user}]}]}
            if schema is not None:
                body["generationConfig"] = {"responseMimeType": "application/json"}
            headers["x-goog-api-key"] = self.key or ""
        else:
            body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False}
            if schema is not None:
                body |= {"format": schema} if self.kind == "ollama" else {"response_format": {"type": "json_object"}}
            if self.key:
                headers["api-key"] = self.key
        return urllib.request.Request(self.url, json.dumps(body).encode(), headers)

    def chat(self, system: str, user: str, schema: dict | None = None) -> str:
        """The model's answer; with a schema the endpoint is asked for JSON. Failed calls are tried again after a pause, the last error is raised."""
        request = self._request(system, user, schema)
        for left in range(self.tries - 1, -1, -1):
            try:
                got = json.loads(self.opener(request, self.timeout))
                break
            except Exception:
                if not left:
                    raise
                time.sleep(self.pause)
        if self.kind == "ollama":
            self.tokens += got.get("prompt_eval_count", 0) + got.get("eval_count", 0)
            return got["message"]["content"]
        if self.kind == "gemini":
            self.tokens += got.get("usageMetadata", {}).get("totalTokenCount", 0)
            return "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"])
        self.tokens += got.get("usage", {}).get("total_tokens", 0)
        return got["choices"][0]["message"]["content"]

    def chat_json(self, system: str, user: str, schema: dict | None = None) -> dict:
        """The answer as an object: the text itself, else the first object inside it."""
        text = self.chat(system, user, {} if schema is None else schema) if self.kind != "ollama" or schema is not None else self.chat(system, user)
        try:
            got = json.loads(text)
        except ValueError:
            return json_object(text)
        return got if isinstance(got, dict) else json_object(text)


def planner(provider, describe: Callable[[str], str]) -> Callable[[str, list[str]], list[Step]]:
    """plan(query, sources) for an Agent."""
    return lambda query, chosen: parse_plan(provider.chat(PLAN_PROMPT, query + "\n\n" + "\n".join(describe(s) for s in chosen)))


def sql_writer(provider, describe: Callable[[str], str]) -> Callable[[Step, dict[int, StepResult], str | None], str]:
    """write_sql(step, earlier results, error) for an Agent; a fence around the query is taken off."""

    def write(step: Step, before: dict[int, StepResult], error: str | None) -> str:
        parts = [describe(step.source_id), step.description, *[f"passo {k}: {json.dumps(r.rows, ensure_ascii=False, default=str)}" for k, r in before.items()]]
        text = provider.chat(SQL_PROMPT, "\n".join(parts + ([f"A consulta anterior falhou: {error}"] if error else []))).strip()
        return text.strip("`").removeprefix("sql").strip() if text.startswith("```") else text

    return write


def answerer(provider) -> Callable[[str, list[Step], list[StepResult]], str]:
    """answer(query, steps, results) for an Agent; results are matched to steps by id."""

    def answer(query: str, steps: list[Step], results: list[StepResult]) -> str:
        by_id = {r.step_id: r for r in results}
        shown = [f"{s.description} [{s.source_id}]: " + (json.dumps(by_id[s.id].rows[:10], ensure_ascii=False, default=str) if s.id in by_id and by_id[s.id].rows else by_id[s.id].status.value if s.id in by_id else "pending") for s in steps]
        return provider.chat(ANSWER_PROMPT, query + "\n\n" + "\n".join(shown))

    return answer
