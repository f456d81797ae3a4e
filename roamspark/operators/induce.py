"""Parser induction: what proposes parsers, and how proposals are validated and repaired."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..sources.chat import Reply, clients
from ..sources.lines import Settings
from .consolidate import Run, induce_all
from .header import HeaderRule, json_in
from .sampling import repair_sample, sample
from .templates import Parser, anchored, compile_template, regex_reply, template_reply, translate

EXAMPLES = 3
SHOWN = 8


@dataclass
class Usage:
    """Calls, tokens and seconds of models."""

    calls: int = 0
    tokens: int = 0
    seconds: float = 0.0
    by_model: dict[str, int] = field(default_factory=dict)

    def add(self, model: str, tokens: int, seconds: float) -> None:
        self.calls += 1
        self.tokens += tokens
        self.seconds += seconds
        self.by_model[model] = self.by_model.get(model, 0) + 1


class Inducer(Protocol):
    def parser(self, lines: list[str], examples: list[tuple[str, str, int]]) -> tuple[str | None, int]:
        """A template (or a regex, by the engine) and a label for lines of one structure."""

    def repair(self, lines: list[str], regex: str, failed: str, info: str) -> list[str]:
        """Other regexes to try, best first."""


# fixed values: words that tell a line's label, and whose address or name follows
IGNORED, LEAVING, JOINING = ("dhcp", "fail", "error", "probe"), ("disassoc", "deauth", "disconnect", "left"), ("assoc", "auth", "connect", "join", "roam")
AP_WORDS, CLIENT_WORDS = {"ap", "bssid"}, {"sta", "client", "station", "user"}
_TOKEN = re.compile(r"\{[^}]*\}|(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z0-9_.-]*[A-Za-z0-9_]|\s+|.", re.S)
_KINDS = [("mac", r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"), ("ip", r"\d{1,3}(?:\.\d{1,3}){3}"), ("name", r"(?=.*[-_\d])[A-Za-z][\w-]*")]


class RuleBased:
    """Offline and deterministic: lines are aligned by token, tokens that differ or are addresses become placeholders, and the nearest word before tells whose they are."""

    def parser(self, lines: list[str], examples: list[tuple[str, str, int]]) -> tuple[str | None, int]:
        rows = [_TOKEN.findall(x) for x in lines]
        text = lines[0].lower()
        flag = 0 if any(w in text for w in IGNORED) else -1 if any(w in text for w in LEAVING) else 1 if any(w in text for w in JOINING) else 0
        if len({len(r) for r in rows}) > 1:
            same = 0
            while all(same < len(r) and r[same] == rows[0][same] for r in rows):
                same += 1
            return "".join(rows[0][:same]) + "{{rest}}" + "|" * all(x.endswith("|") for x in lines), flag
        out, role, seen = [], "", {}
        for column in zip(*rows):
            token = column[0]
            kind = next((k for k, p in _KINDS if all(re.fullmatch(p, t) for t in column)), "")
            if all(t.startswith("{") for t in column):
                name = "json_data"
            elif kind and role:
                name = f"{role}_{kind}"
            elif len(set(column)) > 1 or kind in ("mac", "ip"):
                name = "value"
            else:
                word = token.lower()
                role = "ap" if word in AP_WORDS else "client" if word in CLIENT_WORDS else role
                out.append(token)
                continue
            seen[name] = seen.get(name, 0) + 1
            out.append("{{" + name + (f"_{seen[name] - 1}" if seen[name] > 1 else "") + "}}")
            role = ""
        return "".join(out), flag

    def repair(self, lines: list[str], regex: str, failed: str, info: str) -> list[str]:
        return []


@dataclass
class Recorded:
    """Replies by skeleton or first line, for tests and replays."""

    replies: dict[str, tuple[str | None, int]]
    key: Callable[[str], str] = str
    repairs: dict[str, list[str]] = field(default_factory=dict)

    def parser(self, lines: list[str], examples: list[tuple[str, str, int]]) -> tuple[str | None, int]:
        return self.replies[self.key(lines[0])]

    def repair(self, lines: list[str], regex: str, failed: str, info: str) -> list[str]:
        return self.repairs.get(regex, [])


@dataclass
class Chat:
    """Any chat model behind one function of messages, which returns a text or a Reply; called on the driver alone. reserve may refuse a call by raising; a reservation is committed with
    the tokens that the call used, or released if the call fails."""

    ask: Callable[[list[dict]], str | Reply]
    style: str = "template"
    fallbacks: tuple[Callable[[list[dict]], str | Reply], ...] = ()
    reserve: Callable[[list[dict]], object] = lambda messages: None
    commit: Callable[[object, int], None] = lambda reservation, tokens: None
    release: Callable[[object], None] = lambda reservation: None
    usage: Usage = field(default_factory=Usage)

    @classmethod
    def of(cls, settings: Settings, api_key: str, style: str = "template", **hooks) -> Chat:
        """The models that the settings name, over HTTP."""
        first, others = clients(settings, api_key)
        return cls(first, style, tuple(others), **hooks)

    def _call(self, ask: Callable[[list[dict]], str | Reply], messages: list[dict], model: str) -> str:
        held, began = self.reserve(messages), time.time()
        try:
            reply = ask(messages)
        except BaseException:
            self.release(held)
            raise
        reply = Reply(reply) if isinstance(reply, str) else reply
        tokens = reply.tokens or message_tokens([*messages, {"role": "assistant", "content": reply.content}])
        self.commit(held, tokens)
        self.usage.add(model, tokens, time.time() - began)
        return reply.content

    def parser(self, lines: list[str], examples: list[tuple[str, str, int]]) -> tuple[str | None, int]:
        reply = self._call(self.ask, prompt(lines, examples, self.style), getattr(self.ask, "model", "primary"))
        return template_reply(reply) if self.style == "template" else regex_reply(reply)

    def repair(self, lines: list[str], regex: str, failed: str, info: str) -> list[str]:
        out = []
        for k, ask in enumerate(self.fallbacks[:3]):
            messages = [{"role": "user", "content": f"This pattern fails: {regex}\nLine: {failed}\n{info}\nAll lines:\n" + "\n".join(lines) + "\nAnswer with JSON: regex, connect_flag."}]
            found, _ = regex_reply(self._call(ask, messages, getattr(ask, "model", f"fallback{k}")))
            out += [found] if found else []
        return out

    def header(self, lines: list[str], rule: HeaderRule | None, judged: dict[str, tuple[int, list[str]]] | None) -> HeaderRule:
        """A header rule for lines, or a better one than rule, given what it made of them; ValueError where the reply is none."""
        reply = json_in(self._call(self.ask, header_prompt(lines, rule, judged), getattr(self.ask, "model", "primary")))
        if not isinstance(reply, dict):
            raise ValueError("the reply is not JSON")
        return HeaderRule.from_reply(reply)


def header_prompt(lines: list[str], rule: HeaderRule | None, judged: dict[str, tuple[int, list[str]]] | None) -> list[dict]:
    """Messages that ask for a header rule; with a rule that fell short, also what became of the lines and examples of each outcome."""
    task = "Each log line below starts with a date and a time, perhaps after other fields. Write one Python regular expression with the named groups date and time, which hold the bare values and no marks around them, and strptime formats for both. Answer with JSON alone: regex, date_format, time_format, has_year."
    shown = "\n".join(f"{k}. {x}" for k, x in enumerate(lines, 1))
    if rule is None:
        return [{"role": "system", "content": task}, {"role": "user", "content": shown}]
    total = sum(n for n, _ in (judged or {}).values())
    outcome = "\n\n".join(f"{status}: {n} of {total}\n" + "\n".join(f"  {x}" for x in examples) for status, (n, examples) in sorted((judged or {}).items()))
    held = json.dumps({"regex": rule.regex, "date_format": rule.date_format, "time_format": rule.time_format, "has_year": rule.has_year})
    return [{"role": "system", "content": f"{task} The rule given does not fit enough lines; mend it."}, {"role": "user", "content": f"Rule: {held}\n\nOutcomes, with examples:\n{outcome}\n\nLines:\n{shown}"}]


def message_tokens(messages: list[dict]) -> int:
    """4 for each message, and about one for each four characters."""
    return sum(4 + -(-len(m.get("role", "")) // 4) + -(-len(m.get("content", "")) // 4) for m in messages)


def prompt(lines: list[str], examples: list[tuple[str, str, int]], style: str) -> list[dict]:
    what = "a template with {{placeholders}} that covers the whole line" if style == "template" else "one regular expression with named groups"
    shown = "".join(f"\nExample line: {a}\nAnswer: {b} ({f})" for a, b, f in examples)
    return [{"role": "system", "content": f"Wi-Fi controller lines of one structure follow. Give {what}, and connect_flag: 1 a client joins or tries to, -1 it leaves, 0 anything else. Answer with JSON: {style}, connect_flag."}, {"role": "user", "content": "\n".join(lines) + shown}]


def validate(pattern: str, lines: list[str]) -> tuple[bool, str | None, str, str]:
    """Whether every line matches; the first that fails, where it fails, and input_error, syntax_error or match_fail."""
    if not pattern or not lines:
        return False, None, "", "input_error"
    try:
        compiled = re.compile(pattern)
    except re.error as why:
        return False, None, str(why), "syntax_error"
    for x in lines:
        if not compiled.match(x):
            return False, x, locate(pattern, x), "match_fail"
    return True, None, "", ""


def captures(pattern: str | None, line: str | None) -> dict[str, str | None] | None:
    """What the named groups of a pattern find anywhere in a line whose runs of blanks are single ones; None without a match, or for a pattern that is none."""
    try:
        m = re.search(pattern, " ".join(line.split())) if pattern and line else None
    except re.error:
        return None
    return m and m.groupdict()


def locate(pattern: str, line: str) -> str:
    """The piece of the pattern at which its growing prefix stops matching, and the line from there."""
    cuts, depth, k = [], 0, 0
    while k < len(pattern):
        if pattern[k] == "\\":
            if pattern[k + 1 : k + 2] == "s" and not depth:
                cuts.append(k + 2)
            k += 2
            continue
        depth += (pattern[k] == "(") - (pattern[k] == ")")
        if not depth and pattern[k] in ") ,":
            cuts.append(k + 1)
        k += 1
    good, reached = 0, 0
    for cut in [*cuts, len(pattern)]:
        try:
            m = re.match(pattern[:cut], line)
        except re.error:
            continue
        if not m:
            return f"pattern fails at: {pattern[good : max(cut, good + 30)]} | line there: {line[reached : reached + 50]}"
        good, reached = cut, m.end()
    return f"pattern fails at: {pattern[good:]} | line there: {line[reached : reached + 50]}"


def induce_template(group: dict, inducer: Inducer, examples: list[tuple[str, str, int]], shown: int = SHOWN) -> Parser | None:
    """Ask, once more where no template came; compile, validate on the whole sample, repair where the label matters. A label whose pattern stays broken counts without one."""
    lines = sample(group["sample"], shown)
    template, flag = inducer.parser(lines, examples[-EXAMPLES:])
    if not template:
        template, flag = inducer.parser(lines, examples[-EXAMPLES:])
    if not template:
        return Parser(None, (), flag, lines[0])
    pattern, names = compile_template(template)
    ok, failed, info, _ = validate(pattern.removeprefix("(?d)").replace(r"\z", r"\Z"), group["sample"])
    if ok:
        if flag:
            examples.append((lines[0], template, flag))
        return Parser(pattern, names, flag, lines[0])
    return _repaired(group, inducer, pattern.removeprefix("(?d)").replace(r"\z", r"\Z"), flag, failed, info, lines[0], False)


def induce_regex(group: dict, inducer: Inducer, examples: list[tuple[str, str, int]], shown: int = SHOWN) -> Parser | None:
    """The baseline: a raw regex that matches from the start of the line."""
    lines = sample(group["sample"], shown)
    regex, flag = inducer.parser(lines, examples[:EXAMPLES])
    if not regex:
        return Parser(None, (), flag, lines[0])
    ok, failed, info, _ = validate(regex, group["sample"])
    if ok and (t := translate(regex, whole=True)):
        if flag:
            examples.append((lines[0], regex, flag))
        return Parser(t[0], t[1], flag, lines[0])
    return _repaired(group, inducer, regex, flag, failed, info, lines[0], True)


def _repaired(group: dict, inducer: Inducer, regex: str, flag: int, failed: str | None, info: str, example: str, whole: bool) -> Parser:
    if flag:
        last, again = "", 0
        for other in inducer.repair(repair_sample(group["sample"], failed), regex, failed or "", info)[:3]:
            again = again + 1 if other == last else 0
            if again >= 2:
                break
            last = other
            other = other if whole else anchored(other)
            if validate(other, group["sample"])[0] and (t := translate(other, whole=whole)):
                return Parser(t[0], t[1], flag, example)
    return Parser(None, (), flag, example)


def covers(parser: Parser, group: dict) -> bool:
    """On the driver, over a bounded sample: the whole of each line, the representative first."""
    try:
        compiled = re.compile((parser.pattern or "").removeprefix("(?d)").removeprefix("(?Ud)").replace(r"\z", r"\Z"))
    except re.error:
        return False
    return all(compiled.fullmatch(x) for x in [group["representative"], *group["sample"]])


def induce_groups(groups: list[dict], inducer: Inducer, least: int = 1, style: str = "template", consolidate: bool = True, run: Run | None = None, examples: list[tuple[str, str, int]] | None = None, shown: int = SHOWN) -> Run:
    """examples: what was induced before, to which this adds; shown: lines of a group that the inducer is given."""
    examples = [] if examples is None else examples
    one = induce_template if style == "template" else induce_regex
    return induce_all(groups, least, lambda g: one(g, inducer, examples, shown), covers if consolidate else lambda p, g: False, run)
