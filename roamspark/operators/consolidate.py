"""Groups that an earlier parser covers: the coverage matrix and who absorbs whom."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import Parser


#: Parsers that are tried in one pass over the representatives.
BLOCK = 2000


def coverage(samples: DataFrame, representatives: DataFrame, parsers: DataFrame) -> DataFrame:
    """parser_id, skeleton of the pairs whose representative and every sampled line the pattern matches whole.

    Parsers, one for each group that was induced, are broadcast BLOCK at a time, so all of them meet all representatives, one row a structure; only pairs whose representative matches meet
    their samples."""
    held = parsers.where("pattern is not null").select("parser_id", "pattern")
    blocks = max(1, -(-held.count() // BLOCK))
    out = None
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("parser_id"), F.lit(blocks)) == k)
        first = representatives.select("skeleton", "representative").join(F.broadcast(part), F.expr("representative rlike pattern")).select("parser_id", "skeleton", "pattern")
        out = first if out is None else out.unionByName(first)
    return samples.select("skeleton", "content").join(out, "skeleton").groupBy("parser_id", "skeleton").agg(F.bool_and(F.expr("content rlike pattern")).alias("all")).where("all").select("parser_id", "skeleton")


@dataclass
class Run:
    """The state of induction: which group speaks for a skeleton, groups' parsers, who was absorbed."""

    canon: dict[str, int] = field(default_factory=dict)
    parsers: dict[int, Parser] = field(default_factory=dict)
    consolidated: set[int] = field(default_factory=set)
    processed: set[int] = field(default_factory=set)
    too_small: set[int] = field(default_factory=set)
    details: dict[int, dict] = field(default_factory=dict)

    def open(self, skeleton: str, group: int) -> bool:
        """Whether a parser may still absorb the group: it speaks for its skeleton and has no pattern."""
        return group not in self.consolidated and self.canon[skeleton] == group and not (group in self.parsers and self.parsers[group].pattern)

    def absorb(self, by: int, skeleton: str, group: int) -> None:
        self.canon[skeleton] = by
        self.consolidated.add(group)

    def counts(self) -> dict[str, int]:
        absorbed = self.consolidated - self.too_small
        return {
            "processed": len(self.processed - self.consolidated),
            "too_small": len(self.too_small),
            "consolidated": len(self.consolidated),
            "consolidated_too_small": len(self.consolidated & self.too_small),
            "consolidated_eligible": len(absorbed),
            "skipped": len(self.too_small) + len(absorbed),
            "unmatched": len(self.too_small - self.consolidated),
        }


def induce_all(groups: Iterable[dict], least: int, induce: Callable[[dict], Parser | None], covers: Callable[[Parser, dict], bool], run: Run | None = None) -> Run:
    """Groups (group_id, skeleton, n, first_idx, representative, sample) largest first. Each that still speaks for its skeleton, is large enough and has neither a pattern nor the label 0 is
    induced; a parser with a pattern, whatever its label, then absorbs every other open group without a pattern that it covers, however small. A group whose
    induction fails is labelled 0 in the details, and has no parser."""
    run = run or Run()
    every = sorted(groups, key=lambda g: g["group_id"])
    for g in every:
        run.canon.setdefault(g["skeleton"], g["group_id"])
        if g["n"] < least:
            run.too_small.add(g["group_id"])
    for g in sorted(every, key=lambda g: (-g["n"], g["first_idx"])):
        own = g["group_id"]
        held = run.parsers.get(own)
        if run.canon[g["skeleton"]] != own or own in run.too_small or held and (held.flag == 0 or held.pattern):
            continue
        try:
            parser = induce(g)
        except Exception as why:  # noqa: BLE001  one group's failure is its own
            run.details[own] = {"flag": 0, "error": str(why)}
            run.processed.add(own)
            continue
        run.processed.add(own)
        if parser is None:
            run.details[own] = {"flag": 0}
            continue
        run.parsers[own] = parser
        run.details[own] = {"flag": parser.flag, "pattern": parser.pattern}
        if not parser.pattern:
            continue
        for other in every:
            k = other["group_id"]
            if k != own and run.open(other["skeleton"], k) and other["sample"] and covers(parser, other):
                run.absorb(own, other["skeleton"], k)
    return run
