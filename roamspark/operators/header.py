"""Timestamp headers: rules, splitting, validation, inference."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.lines import strided
from .sampling import sample as pick

MAX_OFFSET = 200
TARGET = 0.90
ATTEMPTS = 4
BASE_YEAR = 1970
LEAD = ' \t,|-:"'
#: strptime directives and what Spark's parser calls them.
DIRECTIVES = {"%Y": "y", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%z": "XX", "%e": "d"}


@dataclass(frozen=True)
class HeaderRule:
    """regex: Python syntax with the groups date and time; formats: strptime's."""

    regex: str
    date_format: str
    time_format: str
    has_year: bool = True

    def __post_init__(self):
        named = re.compile(self.regex).groupindex
        if not {"date", "time"} <= set(named):
            raise ValueError("a header rule needs the groups date and time")
        if not self.date_format or not self.time_format:
            raise ValueError("a header rule needs both formats")

    @classmethod
    def from_reply(cls, reply: dict) -> HeaderRule:
        if not all(isinstance(reply.get(k), str) and reply[k] for k in ("regex", "date_format", "time_format")):
            raise ValueError("a header rule needs regex, date_format and time_format")
        return cls(reply["regex"], reply["date_format"], reply["time_format"], bool(reply.get("has_year", True)))

    def parts(self) -> tuple[str, str, str, str, str, bool] | None:
        """before, first, between, second, after, and whether the date comes first; None if the groups are nested or optional."""
        found = {m[1]: (m.start(), _closing(self.regex, m.start())) for m in re.finditer(r"\(\?P<(date|time)>", self.regex)}
        if len(found) != 2 or any(end < 0 for _, end in found.values()) or re.search(r"\(\?P=|\\\d|\(\?[aiLmsux]", self.regex):
            return None
        (n1, (s1, e1)), (_, (s2, e2)) = sorted(found.items(), key=lambda x: x[1])
        if s2 < e1 or any(self.regex[e : e + 1] in ("?", "*", "+", "{") for e in (e1, e2)):
            return None
        pieces = self.regex[:s1], self.regex[s1 + 9 : e1 - 1], self.regex[e1:s2], self.regex[s2 + 9 : e2 - 1], self.regex[e2:]
        if any(not _balanced(p) for p in pieces) or any("|" in re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", p) for p in (pieces[0], pieces[2], pieces[4])):
            return None
        return (*[_uncaptured(p) for p in pieces], n1 == "date")


def _closing(text: str, at: int) -> int:
    depth, k, inside = 0, at, False
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        elif not inside:
            depth += (c == "(") - (c == ")")
            if c == ")" and not depth:
                return k + 1
        k += 1
    return -1


def _balanced(text: str) -> bool:
    plain = re.sub(r"\\.|\[[^\]]*\]", "", text)
    return plain.count("(") == plain.count(")")


def _uncaptured(text: str) -> str:
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", re.sub(r"\(\?P<\w+>", "(?:", text)).replace("\\Z", "\\z")


def spark_format(fmt: str) -> str | None:
    """strptime's format for try_to_timestamp; None if it has a directive that Spark cannot read alike."""
    out, k, literal = [], 0, ""
    while k < len(fmt):
        if fmt[k] == "%":
            d = fmt[k : k + 2]
            if d == "%T":
                out.append("H:m:s")
            elif d in DIRECTIVES and not (d == "%f"):
                out.append(DIRECTIVES[d])
            elif d == "%f":
                out.append("[SSSSSS][SSSSS][SSSS][SSS][SS][S]")
            else:
                return None
            k += 2
            continue
        literal = fmt[k]
        out.append(f"'{literal}'" if literal.isalpha() else "''" if literal == "'" else literal)
        k += 1
    return "".join(out)


def clean_value(value: Column, fmt: str) -> Column:
    """Quotes, brackets and trailing marks off; Z is +0000 where the format reads a zone."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    v = F.regexp_replace(v, r'^"+|"+$', "")
    v = F.regexp_replace(v, r"^[\[\](){}<>]+|[\[\](){}<>]+$", "")
    v = F.regexp_replace(v, r"[,;|]+$", "")
    return F.regexp_replace(v, "Z$", "+0000") if "%z" in fmt else v


def normalised(raw: Column) -> Column:
    return F.regexp_replace(F.translate(raw, "\t", " "), r"(?U)^\s+|\s+$", "")


def split_header(lines: DataFrame, rule: HeaderRule) -> DataFrame:
    """ts and content (both null where the header does not split), and status: success, no_match, ts_too_far, parse_failed or empty_content.

    Plain rules stay in the JVM: one pattern finds both groups, and what it matches after the later one stays content. Others run in Python, a batch at a time."""
    parts = rule.parts()
    pattern = _date_pattern(rule)
    return _native(lines, rule, parts, pattern) if parts and pattern else _python(lines, rule)


def _date_pattern(rule: HeaderRule) -> str | None:
    d, t = spark_format(rule.date_format), spark_format(rule.time_format)
    return None if d is None or t is None or "[" in d else f"{'' if rule.has_year else 'y '}{d} {t}"


def _native(lines: DataFrame, rule: HeaderRule, parts, pattern: str) -> DataFrame:
    before, one, between, two, after, date_first = parts
    whole = rf"(?U)\A([\s\S]*?{before})({one}){between}({two})(?={after})([\s\S]*)\z"
    line = normalised(F.col("raw"))
    x = F.regexp_replace("_line", whole, "\u0002$1\u0001$2\u0001$3\u0001$4")
    marked = F.when(F.col("_x").startswith("\u0002"), F.split(F.substr("_x", F.lit(2)), "\u0001", 4))
    slowly = F.when(F.col("_line").rlike(whole), F.array(*[F.regexp_extract("_line", whole, k) for k in range(1, 5)]))  # a pass for each group, where the line holds a mark of its own
    got = once(lines, _line=line)
    got = once(got, _x=F.when(~F.col("_line").rlike("[\u0001\u0002]"), x))
    got = once(got, _p=F.when(F.col("_x").isNotNull(), marked).otherwise(slowly))
    date, time = (F.element_at("_p", F.lit(k)) for k in ((2, 3) if date_first else (3, 2)))
    text = F.concat_ws(" ", *([] if rule.has_year else [F.lit(str(BASE_YEAR))]), clean_value(date, rule.date_format), clean_value(time, rule.time_format))
    ts = F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit(re.sub(r"\s+", " ", pattern)))
    content = F.regexp_replace(F.element_at("_p", F.lit(4)), r'^[ \t,|\-:"]+', "")
    got = once(got, _ts=ts, _c=content, _far=F.length(F.element_at("_p", F.lit(1))) > MAX_OFFSET)
    status = F.when(F.col("_p").isNull(), "no_match").when(F.col("_far"), "ts_too_far").when(F.col("_ts").isNull(), "parse_failed").when(normalised(F.col("_c")) == "", "empty_content").otherwise("success")
    got = once(got, status=status)
    ok = F.col("status").isin("success", "empty_content")
    return got.select(*lines.columns, F.when(ok, F.col("_ts")).alias("ts"), F.when(ok, F.col("_c")).alias("content"), "status")


def parse_value(date: str, time: str, rule: HeaderRule) -> datetime:
    def cleaned(v: str, fmt: str) -> str:
        v = v.strip().strip('"').strip("[](){}<>").rstrip(",;|")
        return v[:-1] + "+0000" if "%z" in fmt and v.endswith("Z") else v

    def read(v: str, fmt: str) -> datetime:
        v = cleaned(v, fmt)
        try:
            return datetime.strptime(v, fmt)
        except ValueError:
            return datetime.strptime(v.rstrip(" \t,;|"), fmt)

    d, t = read(date, rule.date_format), read(time, rule.time_format)
    out = datetime.combine(d.date(), t.timetz()).replace(tzinfo=t.tzinfo or d.tzinfo)
    out = out if rule.has_year else out.replace(year=BASE_YEAR)
    return out.astimezone(timezone.utc).replace(tzinfo=None) if out.tzinfo else out


def split_text(raw: str | None, rule: HeaderRule) -> tuple[datetime | None, str | None, str]:
    """split_header for one line."""
    line = (raw or "").replace("\t", " ").strip()
    m = re.search(rule.regex, line) if line else None
    if not m or m["date"] is None or m["time"] is None:
        return None, None, "no_match" if not m else "parse_failed"
    if min(m.start("date"), m.start("time")) > MAX_OFFSET:
        return None, None, "ts_too_far"
    try:
        ts = parse_value(m["date"], m["time"], rule)
    except ValueError:
        return None, None, "parse_failed"
    content = line[max(m.end("date"), m.end("time")) :].lstrip(LEAD)
    return ts, content, "success" if content.strip() else "empty_content"


def _python(lines: DataFrame, rule: HeaderRule) -> DataFrame:
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [split_text(r, rule) for r in b["raw"]]
            yield b.assign(ts=pd.Series([g[0] for g in got], index=b.index, dtype="datetime64[us]"), content=[g[1] for g in got], status=[g[2] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInPandas(run, f"{fields}, ts timestamp, content string, status string")


def report(split: DataFrame, examples: int = 5) -> DataFrame:
    """status, n, the first examples by line number; the success rate follows from it. The window keeps so many of each status in each task before it shuffles."""
    first = split.select("status", "line_index", "raw").withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy("line_index"))).where(F.col("place") <= examples)
    shown = first.groupBy("status").agg(F.sort_array(F.collect_list(F.struct("line_index", "raw")))["raw"].alias("examples"))
    return split.groupBy("status").agg(F.count("*").alias("n")).join(shown, "status")


def success_rate(counts: dict[str, int]) -> float:
    total = sum(counts.values())
    return counts.get("success", 0) / total if total else 0.0


#: Headers that need no model: regex, date format, time format, year.
CATALOGUE = [
    HeaderRule(r"(?P<date>\d{4}-\d\d-\d\d)[T\s](?P<time>\d\d:\d\d:\d\d)", "%Y-%m-%d", "%H:%M:%S"),
    HeaderRule(r"(?P<date>\d{4}/\d{1,2}/\d{1,2})\s+(?P<time>\d{1,2}:\d\d:\d\d)", "%Y/%m/%d", "%H:%M:%S"),
    HeaderRule(r"(?P<date>\d{1,2}/\d{1,2}/\d{4})\s+(?P<time>\d{1,2}:\d\d:\d\d)", "%m/%d/%Y", "%H:%M:%S"),
    HeaderRule(r"date=(?P<date>\d{4}-\d\d-\d\d)\s+time=(?P<time>\d\d:\d\d:\d\d)", "%Y-%m-%d", "%H:%M:%S"),
    HeaderRule(r"(?P<date>[A-Z][a-z]{2}\s+\d{1,2}\s+\d{4})\s+(?P<time>\d\d:\d\d:\d\d)", "%b %d %Y", "%H:%M:%S"),
    HeaderRule(r"(?P<date>[A-Z][a-z]{2}\s+\d{1,2})\s+(?P<time>\d\d:\d\d:\d\d)", "%b %d", "%H:%M:%S", False),
    HeaderRule(r"(?P<date>\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4})\s+(?P<time>\d\d:\d\d:\d\d)", "%d %b %Y", "%H:%M:%S"),
]


def shown_lines(sample: DataFrame, most: int = 10) -> list[str]:
    """At most so many lines that differ as much as possible, of up to 2000 evenly spaced ones."""
    lines = [r.raw for r in strided(sample).collect()]
    try:
        return pick(lines, most)
    except ValueError:  # no words
        return lines[:most]


def judged(sample: DataFrame, rule: HeaderRule) -> dict[str, tuple[int, list[str]]]:
    """Of each status the number of lines and the first examples."""
    return {r.status: (r.n, list(r.examples)) for r in report(split_header(sample, rule)).collect()}


def infer(sample: DataFrame, propose: Callable[[list[str], HeaderRule | None, dict[str, tuple[int, list[str]]] | None], HeaderRule | None] | None = None) -> HeaderRule:
    """A rule that at least TARGET of the sample's lines split by, in at most ATTEMPTS proposals; an exception uses one up. A later proposal is given the rule before and how it was judged.
    Without propose, the best of the catalogue, all of which one pass judges."""
    if propose is None:
        return _of_catalogue(sample)
    shown = shown_lines(sample)
    rule, outcome = None, None
    for _ in range(ATTEMPTS):
        try:
            rule = propose(shown, rule, outcome) or rule
        except Exception:  # noqa: BLE001  a failed proposal uses an attempt up
            continue
        if rule is None:
            continue
        outcome = judged(sample, rule)
        if success_rate({k: n for k, (n, _) in outcome.items()}) >= TARGET:
            return rule
    raise ValueError(f"no header rule reached {TARGET:.0%}")


def _of_catalogue(sample: DataFrame) -> HeaderRule:
    """The first of the rules that split most lines."""
    rows = sample.select("line_index", "raw")
    for k, rule in enumerate(CATALOGUE):
        rows = split_header(rows, rule).withColumn(f"ok{k}", F.col("status") == "success").drop("ts", "content", "status")
    got = rows.agg(F.count("*").alias("n"), *[F.count_if(f"ok{k}").alias(f"ok{k}") for k in range(len(CATALOGUE))]).first()
    best = max(range(len(CATALOGUE)), key=lambda k: got[f"ok{k}"])
    rate = got[f"ok{best}"] / got.n if got.n else 0.0
    if rate < TARGET:
        raise ValueError(f"no known header fits: the best splits {rate:.1%}")
    return CATALOGUE[best]


def json_in(text: str) -> dict | None:
    """The text as JSON, else from its first brace to its last."""
    for candidate in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        try:
            return json.loads(candidate)
        except json.JSONDecodeError:
            continue
    return None


@dataclass(frozen=True)
class DateRule:
    """The older rule of one group ts and one format."""

    regex: str
    format: str

    @classmethod
    def build(cls, lines: list[str], ask: Callable[[list[dict]], str]) -> DateRule:
        """From a model's reply to the first 10 of the first 50 lines that are not blank; ValueError where it has no rule, or one that no line fits."""
        some = [x for x in lines if x.strip()][:50]
        task = "Write a Python regular expression with the named group ts for the timestamp of these log lines, and its strptime format. Answer with JSON alone: regex, format."
        held = json_in(ask([{"role": "system", "content": task}, {"role": "user", "content": "\n".join(some[:10])}]))
        if not isinstance(held, dict) or not all(isinstance(held.get(k), str) and held[k] for k in ("regex", "format")) or "ts" not in re.compile(held["regex"]).groupindex:
            raise ValueError("the reply holds no rule")
        rule = cls(held["regex"], held["format"])
        if not rule.usable(some):
            raise ValueError("no line fits the rule")
        return rule

    def parse(self, line: str) -> datetime | None:
        m = re.search(self.regex, line)
        try:
            return datetime.strptime(m["ts"].strip(), self.format) if m else None
        except (ValueError, IndexError):
            return None

    def usable(self, lines: list[str]) -> bool:
        """If any of the first 20 lines that are not blank parses."""
        return any(self.parse(x) for x in [x for x in lines if x.strip()][:20])
