"""A question-answering loop over tools: plan, run, judge, summarise. Models are callables; without one all parts are fixed rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tool = Callable[..., Any]


def extract_json(text: Column) -> Column:
    """The text from the first opening to the last closing brace, without code fences; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)


def parse_plan(text: str, question: str, most: int = 3) -> list[dict]:
    """The first steps of a planner's JSON, or one semantic search for the question."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        steps = json.loads(m[0]).get("steps", []) if m else []
    except ValueError:
        steps = []
    steps = [s for s in steps if isinstance(s, dict) and s.get("tool")]
    return [{"step_id": i + 1, "tool": s["tool"], "args": s.get("args") or {}} for i, s in enumerate(steps[:most])] or [{"step_id": 1, "tool": "semantic_search", "args": {"query": question}}]


def parse_evaluation(text: str) -> dict | None:
    """What an evaluator said: sufficient, failed_steps (ids), missing; None if it holds no such object. Code fences and talk around it do not matter."""
    m = re.search(r"\{.*\}", re.sub(r"```(?:json)?", "", text or ""), re.S)
    try:
        said = json.loads(m[0]) if m else None
    except ValueError:
        said = None
    if not isinstance(said, dict) or not isinstance(said.get("sufficient"), bool):
        return None
    return {"sufficient": said["sufficient"], "failed_steps": [int(x) for x in said.get("failed_steps") or [] if str(x).isdigit()], "missing": [str(x) for x in said.get("missing") or []]}


def chat_prompt(turns: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """(conversation, prompt): its turns in order as ``ROLE: text``, with blank lines between."""
    said = F.concat(F.upper(role), F.lit(": "), F.coalesce(text, F.lit("")))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("t")))), lambda x: x["t"]), "\n\n").alias("prompt"))


def distinct_facts(facts: DataFrame, fact: str, order: str) -> DataFrame:
    """Facts, each once, with the first place it has."""
    return facts.where(F.trim(fact) != "").groupBy(fact).agg(F.min(order).alias(order))


def discovered_symbol(results: DataFrame, question: str, order: str, symbol: str, path: str) -> DataFrame:
    """(question, symbol): of its results the first whose path lacks ``test``, else the first."""
    best = F.min_by(symbol, F.struct(F.coalesce(F.col(path).contains("test"), F.lit(False)), F.col(order)))
    return results.where(F.col(symbol).isNotNull()).groupBy(question).agg(best.alias(symbol))


def heuristic_verdicts(outputs: DataFrame, question: str, output: str) -> DataFrame:
    """(question, sufficient, failed): sufficient if any output is neither empty nor an error; failed counts the others."""
    bad = F.coalesce((F.trim(output) == "") | F.lower(output).startswith("error"), F.lit(True))
    return outputs.groupBy(question).agg(F.bool_or(~bad).alias("sufficient"), F.sum(bad.cast("bigint")).alias("failed"))


@dataclass
class Agent:
    """Runs plans over a registry of tools; ``planner``, ``evaluator`` and ``writer`` may be models.

    An evaluator says whether results suffice, or gives a text for ``parse_evaluation``: steps that it calls failed are pruned, what
    is missing goes to the next plan. One that says nothing usable is passed over.
    """

    tools: dict[str, Tool]
    planner: Callable[[str, list[str]], str] | None = None
    evaluator: Callable[[str, list[dict]], bool | str] | None = None
    writer: Callable[[str, list[str]], str] | None = None
    most_plans: int = 2
    trace: list[dict] = field(default_factory=list)

    def _run(self, step: dict, symbol: str | None) -> dict:
        args = {k: symbol if v == "$DISCOVERED_SYMBOL" and symbol else v for k, v in step["args"].items()}
        try:
            out = self.tools[step["tool"]](**args)
        except Exception as e:  # a tool's failure is a result
            out = {"error": f"{type(e).__name__}: {e}"}
        return {**step, "args": args, "output": out}

    @staticmethod
    def _good(result: dict) -> bool:
        return bool(result["output"]) and not (isinstance(result["output"], dict) and result["output"].get("error"))

    @staticmethod
    def _symbol(result: dict, last: str | None) -> str | None:
        out = result["output"]
        if isinstance(out, dict) and out.get("symbol") and not out.get("error"):
            return out["symbol"]
        rows = out.get("results") if isinstance(out, dict) else None
        named = [r for r in rows or [] if r.get("name")]
        return next((r["name"] for r in named if "test" not in (r.get("file_path") or "")), named[0]["name"] if named else last)

    def ask(self, question: str) -> str:
        """An answer from the tools' outputs; planned again, at most twice in all, while nothing good has come."""
        self.trace, facts, bad, symbol = [], [], [], None
        for _ in range(self.most_plans):
            plan = parse_plan(self.planner(question, bad) if self.planner else "", question)
            results = []
            for step in plan:
                r = self._run(step, symbol)
                symbol = self._symbol(r, symbol)
                r["status"] = "VERIFIED" if self._good(r) else "PRUNED"
                results.append(r)
            verdict = self.evaluator(question, results) if self.evaluator else None
            if isinstance(verdict, str):
                said = parse_evaluation(verdict)
                verdict = said and said["sufficient"]
                for r in results:
                    if said and r["step_id"] in said["failed_steps"]:
                        r["status"] = "PRUNED"
                bad += [f"missing: {x}" for x in said["missing"]] if said else []
            self.trace += results
            facts += [json.dumps(r["output"], default=str, sort_keys=True) for r in results if r["status"] == "VERIFIED"]
            bad += [f"{r['tool']} found nothing" for r in results if not self._good(r)]
            if verdict if verdict is not None else any(map(self._good, results)):
                break
        facts = list(dict.fromkeys(facts))
        if self.writer and facts:
            return self.writer(question, facts)
        if not facts:
            return "No verified facts were found."
        return "\n".join([*(f"- {f}" for f in facts), *(f"- (negative) {b}" for b in dict.fromkeys(bad))])
