"""Templates with {{placeholders}}, and the regular expressions that they and raw patterns become in Java's dialect."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# fixed values: placeholders that become captures
FIELDS = {"year", "month", "date", "time", "ampm", "client_ip", "ap_ip", "client_mac", "ap_mac", "client_name", "ap_name", "json_data"}
_PLACE = re.compile(r"\{\{([A-Za-z_][A-Za-z0-9_]*)\}\}")


@dataclass(frozen=True)
class Parser:
    """A parser of one group: Java pattern over the whole line, its captures' names by position (a repeated name counts where it stands last), and the label."""

    pattern: str | None
    names: tuple[str, ...]
    flag: int
    example: str = ""


def base_name(name: str) -> str:
    return re.sub(r"_\d+$", "", name)


def literal(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def compile_template(template: str | None) -> tuple[str, tuple[str, ...]]:
    """Pattern and names of a template that covers a whole line; ValueError where there is none."""
    if not template or not template.strip():
        raise ValueError("no template")
    pieces = _PLACE.split(template)  # literals at even places, names at odd ones
    named = [n for n in pieces[1::2] if base_name(n) in FIELDS]
    pieces[::2] = map(literal, pieces[::2])
    pieces[1::2] = ["(.*?)" if n in named else ".*?" for n in pieces[1::2]]
    return rf"(?d)\A{''.join(pieces)}\z", tuple(named)


def anchored(regex: str) -> str:
    head = "" if regex.startswith((r"\A", "^")) else r"\A"
    return head + regex + ("" if regex.endswith((r"\Z", "$")) else r"\Z")


def translate(regex: str, whole: bool = False) -> tuple[str, tuple[str, ...]] | None:
    """A Python pattern as Java's, with the names of its captures by position; None where it cannot be translated. whole: the pattern matches a prefix (Python's match), so the rest of the line is let through."""
    try:
        re.compile(re.sub(r"\(\?P=\w+\)", "", re.sub(r"\(\?P<(\w+)>", "(", regex)))  # names may repeat
    except re.error:
        return None
    names: list[str] = []
    out, k, inside = [], 0, False
    while k < len(regex):
        c = regex[k]
        if c == "\\":
            if regex[k + 1 : k + 2] == "Z":
                out.append(r"\z")
            else:
                out.append(regex[k : k + 2])
            k += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if regex[k + 1 : k + 2] == "]" or regex[k + 1 : k + 3] == "^]":
                n = 2 if regex[k + 1] == "]" else 3
                out.append(regex[k : k + n - 1] + "\\]")
                k += n
                continue
        elif c == "(":
            if m := re.match(r"\(\?P<(\w+)>", regex[k:]):
                names.append(m[1])
                out.append("(")
                k += m.end()
                continue
            if m := re.match(r"\(\?P=(\w+)\)", regex[k:]):
                if m[1] not in names:
                    return None
                out.append(f"\\{len(names) - names[::-1].index(m[1])}")
                k += m.end()
                continue
            if regex[k + 1 : k + 2] != "?":
                out.append("(?:")  # unnamed captures are not kept
                k += 1
                continue
        out.append(c)
        k += 1
    body = "".join(out)
    return (rf"(?Ud)\A(?:{body})[\s\S]*\z" if whole else f"(?Ud){body}"), tuple(names)


def flag_of(value: object) -> int:
    return value if isinstance(value, int) and not isinstance(value, bool) else int(value) if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value.strip()) else 0


def template_reply(text: str) -> tuple[str | None, int]:
    """template and connect_flag of a model's reply: the whole as JSON, else a fenced block, else the first brace that decodes. A blank template is None, a flag that is no whole number 0."""
    for candidate in _candidates(text or ""):
        template = candidate.get("template")
        return (template if isinstance(template, str) and template.strip() else None), flag_of(candidate.get("connect_flag"))
    return None, 0


def _candidates(text: str):
    for part in [text, *re.findall(r"```(?:\w+)?\s*(.*?)```", text, re.S)]:
        try:
            if isinstance(held := json.loads(part.strip()), dict):
                yield held
        except json.JSONDecodeError:
            continue
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            held, _ = decoder.raw_decode(text[m.start() :])
        except json.JSONDecodeError:
            continue
        if isinstance(held, dict):
            yield held


def regex_reply(text: str) -> tuple[str | None, int]:
    """regex and connect_flag of a baseline reply: as JSON, else by the quoted value after the key, with escapes undone."""
    for held in _candidates(text or ""):
        regex = held.get("regex")
        return (regex if isinstance(regex, str) and regex.strip() else None), flag_of(held.get("connect_flag"))
    flag = re.search(r'"connect_flag"\s*:\s*"?([+-]?\d+)', text or "")
    at = re.search(r'"regex"\s*:\s*"', text or "")
    if not at:
        return None, int(flag[1]) if flag else 0
    out, k = [], at.end()
    while k < len(text) and text[k] != '"':
        if text[k] == "\\" and k + 1 < len(text):
            out.append(text[k + 1] if text[k + 1] in '"\\/' else text[k : k + 2])
            k += 2
        else:
            out.append(text[k])
            k += 1
    return "".join(out) or None, int(flag[1]) if flag else 0
