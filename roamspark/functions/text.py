"""Column functions over log content: clean-up, structural skeleton, embedded JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: top-level domains, JSON fragments, numbered keys, blanks inside angle brackets, and pattern and replacement of each skeleton rule, in order; rules have no lookahead, so
# that RE2 runs them too
TOP_LEVEL_DOMAINS = "com|org|net|edu|gov|mil|int|co|io|me|tv|info|biz|name"
FRAGMENT = r"\{[^}]*\}"
NUMBERED_KEY = r"^[a-zA-Z_]+_\d+$"
ANGLES = r"<\s*([^<>]*?)\s*>"
SKELETON_RULES = [
    (rf"(www\.)?[a-zA-Z0-9.-]+\.({TOP_LEVEL_DOMAINS})", ""),
    (r"[A-Za-z0-9]*-[A-Za-z0-9-]*", ""),
    (r"/[a-zA-Z0-9_./\\-]+([|\s:,;!?]|$)", "$1"),
    (r"[a-zA-Z]:\\[a-zA-Z0-9_.\\/-]+([|\s:,;!?]|$)", "$1"),
    (r"0x[0-9a-fA-F]+", ""),
    (r"\b[0-9a-fA-F]{2}(?:[0-9a-fA-F]{2})*\b", ""),
    (r"\d", ""),
    (r"=", ""),
    (r"\s+", ""),
]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once: filters and later columns read the result and do not repeat the expression, as they would through a projection."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    held = [c for c in df.columns if c not in columns]
    return df.select(*held, F.explode(F.array(made)).alias("_once")).select(*held, *[F.col(f"_once.{n}").alias(n) for n in columns])


def preprocess(content: Column) -> Column:
    """Inner blanks of <...> go, tabs are blanks, runs of blanks are one, ends are stripped, and one bar closes the line."""
    c = F.regexp_replace(content, f"(?U){ANGLES}", "<$1>")
    c = F.regexp_replace(F.translate(c, "\t", " "), r"(?U)\s{2,}", " ")
    return F.concat(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("|"))


def _ascii(pattern: str) -> str:
    """A skeleton rule over ASCII blanks, digits and word ends."""
    words = r"(?<![A-Za-z0-9_])[0-9a-fA-F]{2}(?:[0-9a-fA-F]{2})*(?![A-Za-z0-9_])"
    return pattern.replace(r"\b[0-9a-fA-F]{2}(?:[0-9a-fA-F]{2})*\b", words).replace(r"[|\s:", r"[|\t\n\f\r :").replace(r"\s", r"[\t\n\f\r ]")


def skeleton(content: Column, ascii_only: bool = False) -> Column:
    """The structure of a line. Blanks, digits and word ends are Unicode ones, whose patterns run only on lines that are not ASCII; ascii_only agrees with RE2."""

    def by(form: Callable[[str], str]) -> Column:
        out = content
        for pattern, new in SKELETON_RULES:
            out = F.regexp_replace(out, form(pattern), new)
        return out

    if ascii_only:
        return by(lambda p: "(?d)" + _ascii(p))
    plain = by(lambda p: "(?d)" + p.replace(r"\s", r"[\t-\r ]").replace(r"[|[\t-\r ]:", r"[|\t-\r :"))
    return F.when(F.length(content) == F.octet_length(content), plain).otherwise(by(lambda p: "(?Ud)" + p))


def json_fragments(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(f"({FRAGMENT})"), 1)


def fragment_keys(fragment: Column) -> Column:
    """Keys of a fragment: of valid JSON, else whatever is quoted before a colon; none if any key ends in _<digits>."""
    keys = F.coalesce(F.json_object_keys(fragment), F.regexp_extract_all(fragment, F.lit(r'"([^"]+)"\s*:'), 1))
    return F.when(~F.exists(keys, lambda k: k.rlike(NUMBERED_KEY)), keys).otherwise(F.array().cast("array<string>"))


#: A flat fragment whose keys are printable ASCII and whose values are such text, whole numbers, true, false or null: what is written again is then what was read.
_TEXT, _VALUE = r'"[ !#-\[\]-z|~]*"', r'(?:"[ !#-\[\]-z|~]*"|-?(?:0|[1-9][0-9]*)|true|false|null)'
_PAIR = rf"[ \t]*{_TEXT}[ \t]*:[ \t]*{_VALUE}[ \t]*"
PLAIN = rf"\A\{{(?:{_PAIR}(?:,{_PAIR})*|[ \t]*)\}}\z"


def standardise_text(content: str | None, keys: list[str]) -> str | None:
    """Each valid flat fragment rewritten with exactly the keys, in order; others unchanged."""
    if not content or not keys:
        return content
    parts = re.split(f"({FRAGMENT})", content)  # fragments stand at odd places
    parts[1::2] = [_rewritten(f, keys) or f for f in parts[1::2]]
    return "".join(parts)


def _rewritten(fragment: str, keys: list[str]) -> str | None:
    try:
        held = json.loads(fragment)
    except ValueError:
        return None
    numbered = re.compile(NUMBERED_KEY)
    if any(map(numbered.match, held)):
        return None
    dumps = json.JSONEncoder(separators=(",", ":")).encode
    return "{" + ",".join(f"{dumps(k)}:{dumps(held.get(k, ''))}" for k in keys) + "}"


def standardise(content: Column, keys: list[str]) -> Column:
    """standardise_text: by expressions where all fragments of a line are PLAIN, in Python for the lines that hold another one."""
    if not keys:
        return content
    pair = rf"({_TEXT})[ \t]*:[ \t]*({_VALUE})"

    def one(fragment: Column) -> Column:
        names, values = (F.reverse(F.regexp_extract_all(fragment, F.lit(pair), F.lit(k))) for k in (1, 2))  # of equal keys the last counts
        value = lambda k: F.try_element_at(values, F.nullif(F.array_position(names, F.lit(k)), F.lit(0)).cast("int"))
        numbered = F.exists(names, lambda k: F.substr(k, F.lit(2), F.length(k) - 2).rlike(NUMBERED_KEY))
        body = F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), F.coalesce(value(json.dumps(k)), F.lit('""'))) for k in keys])
        return F.when(numbered, fragment).otherwise(F.concat(F.lit("{"), body, F.lit("}")))

    @F.pandas_udf(T.StringType())
    def rewritten(values: pd.Series) -> pd.Series:
        return values.map(lambda v: standardise_text(v, keys), na_action="ignore")

    fragments = json_fragments(content)
    plain = F.forall(fragments, lambda f: f.rlike(PLAIN))
    native = F.concat_ws("", F.flatten(F.zip_with(F.split(content, FRAGMENT, -1), F.concat(F.transform(fragments, one), F.array(F.lit(""))), lambda x, y: F.array(x, y))))
    return F.when(~content.rlike(FRAGMENT), content).when(plain, native).otherwise(rewritten(F.when(~plain, content)))
