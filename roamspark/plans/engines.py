"""Engines: from lines to records, by name."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import consolidate, extract, groups, header, induce
from ..operators.consolidate import Run
from ..session import local_table, staged
from ..sources import lines as sources
from ..sources.sinks import Progress, batches


#: Groups whose samples are on the driver at a time.
AT_ONCE = 500


@dataclass
class Result:
    records: DataFrame
    events: DataFrame
    details: dict
    stats: dict
    table: DataFrame
    streamed: int = 0

    def payload(self) -> DataFrame:
        return extract.payload(self.records)


@dataclass
class Engine:
    """State that stays between calls: header rule (until a file begins), parsers, which group speaks for a skeleton."""

    spark: SparkSession
    inducer: induce.Inducer = field(default_factory=induce.RuleBased)
    settings: sources.Settings = field(default_factory=sources.Settings)
    propose_header: Callable | None = None
    rule: header.HeaderRule | None = None
    run: Run = field(default_factory=Run)
    style: str = "template"
    consolidate: bool = True
    json_sample: int | None = 2000
    known: DataFrame | None = None

    def process_file(self, path: str, progress: Callable[[dict], None] | None = None) -> Result:
        self.rule = None
        return self.process(self.read(path), progress)

    def process_logs(self, logs: Iterable[str], progress: Callable[[dict], None] | None = None) -> Result:
        return self.process(sources.lines_of(self.spark, logs), progress)

    def process_file_stream(self, path: str, on_batch: Callable[[list[dict]], None], size: int = 2000, progress: Callable[[dict], None] | None = None) -> Result:
        return self._streamed(self.process_file(path, progress), on_batch, size)

    def process_logs_stream(self, logs: Iterable[str], on_batch: Callable[[list[dict]], None], size: int = 2000, progress: Callable[[dict], None] | None = None) -> Result:
        return self._streamed(self.process_logs(logs, progress), on_batch, size)

    def _streamed(self, out: Result, on_batch: Callable[[list[dict]], None], size: int) -> Result:
        for part in batches(out.payload(), size):
            on_batch(part)
            out.streamed += len(part)
        out.stats["records_streamed"] = out.streamed
        return out

    def read(self, path: str) -> DataFrame:
        return sources.read_lines(self.spark, path)

    def process(self, lines: DataFrame, progress: Callable[[dict], None] | None = None) -> Result:
        """One pass over lines parses them into the shared folder, where groups, samples and records are read from."""
        began, tell = time.time(), Progress(progress, chunk=self.settings.chunk_size)
        first = staged(sources.sample_lines(lines), "first")
        if not first.limit(1).count():
            return self._empty(lines, lines.count())
        self.rule = self.rule or header.infer(first, self.propose_header or getattr(self.inducer, "header", None))
        tell("scan", 0.1)
        source = lines if self.json_sample is None else first  # the first kept lines are among the first lines, as the rule splits most of those
        keys = groups.json_keys(groups.kept(header.split_header(source, self.rule)).select("line_index", "content"), self.json_sample)
        seen, kept = Observation(), Observation()
        parsed = groups.parsed_lines(lines.observe(seen, F.count(F.lit(1)).alias("n")), self.rule, keys)
        with tell.watching(self.spark, "scan"):
            parsed = staged(parsed.observe(kept, F.count(F.lit(1)).alias("n")), "parsed")
        total, n_kept = seen.get["n"], kept.get["n"]
        tell("scan", 1.0, lines_processed=total)
        own = staged(groups.micro_groups(parsed), "groups")
        found = own if self.known is None else staged(groups.merge_groups(self.known, own), "groups")
        self.known = found
        n_groups = found.count()
        self.run = self._induced(parsed, found, lambda done: tell("induce", done))
        tell("induce", 1.0)
        table = extract.parser_table(self.spark, self.run.canon, self.run.parsers)
        count = Observation()
        with tell.watching(self.spark, "extract", total):
            rows = staged(extract.records(parsed, table).observe(count, F.count(F.lit(1)).alias("n")), "records")
        tell("extract", 1.0, lines_processed=total, records_found=count.get["n"])
        usage = getattr(self.inducer, "usage", induce.Usage())
        stats = {"lines": total, "lines_kept": n_kept, "groups": n_groups, "records": count.get["n"], **self.run.counts(), "llm_calls": usage.calls, "llm_tokens": usage.tokens, "llm_time": usage.seconds, **extract.lookup_stats(own, table, "n").first().asDict(), "runtime_sec": time.time() - began}
        return Result(rows, extract.line_events(parsed, table), self.run.details, stats, table)

    def _induced(self, parsed: DataFrame, found: DataFrame, tell: Callable[[float], None]) -> Run:
        """Parsers are induced on the driver, AT_ONCE groups at a time, the largest first; after each round one coverage join over the other groups finds those that the new parsers absorb.

        Of a group that is absorbed or too small no line reaches the driver; of the others at most a bounded sample."""
        samples = staged(groups.group_sample(parsed, seed=self.settings.seed).select("skeleton", "line_index", "content"), "samples")
        run, least = self.run, self.settings.min_cluster_size
        tried: set[int] = set()
        names = found.join(samples.select("skeleton").distinct(), "skeleton")  # of this scan
        todo, of = [], {}
        for r in names.orderBy(F.desc("n"), "first_idx").select("skeleton", "group_id", "n").collect():  # a short row for each structure
            of[r.skeleton] = r.group_id
            run.canon.setdefault(r.skeleton, r.group_id)
            if r.n < least:
                run.too_small.add(r.group_id)
            else:
                run.too_small.discard(r.group_id)
                todo.append((r.skeleton, r.group_id))
        examples: list = []
        while True:
            open_ = [s for s, g in todo if run.canon[s] == g and g not in tried]
            tell(1 - len(open_) / max(len(todo), 1))
            if not open_:
                return run
            now = open_[:AT_ONCE]
            chosen = local_table(self.spark, [(s,) for s in now], "skeleton string")
            rows = [r.asDict() for r in names.join(F.broadcast(chosen), "skeleton").select("skeleton", "n", "first_idx", "representative", "group_id").collect()]
            lines: dict[str, list[str]] = {}
            for r in samples.join(F.broadcast(chosen), "skeleton").orderBy("skeleton", "line_index").select("skeleton", "content").collect():
                lines.setdefault(r.skeleton, []).append(r.content)
            before = set(run.parsers)
            induce.induce_groups([{**g, "sample": lines[g["skeleton"]]} for g in rows], self.inducer, least, self.style, self.consolidate, run, examples, self.settings.batch_size)
            tried.update(g["group_id"] for g in rows)
            made = list(run.parsers)  # in the order of their making
            new = [(place, run.parsers[k].pattern) for place, k in enumerate(made) if k not in before and run.parsers[k].pattern]
            others = [s for s, g in of.items() if s not in lines and run.open(s, g)]
            if new and others and self.consolidate:
                held = local_table(self.spark, new, "parser_id long, pattern string")
                rest = local_table(self.spark, [(s,) for s in others], "skeleton string")
                met = consolidate.coverage(samples.join(rest, "skeleton"), names.join(rest, "skeleton"), held).groupBy("skeleton").agg(F.min("parser_id").alias("first")).collect()
                for r in met:
                    run.absorb(made[r["first"]], r.skeleton, of[r.skeleton])

    def _empty(self, lines: DataFrame, total: int) -> Result:
        table = extract.parser_table(self.spark, {}, {})
        parsed = lines.limit(0).select("line_index", "raw", F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("content"), F.lit("").alias("skeleton"))
        return Result(extract.records(parsed, table), extract.line_events(parsed, table), {}, {"lines": total, "lines_kept": 0, "groups": 0, "records": 0, **Run().counts(), "llm_calls": 0, "llm_tokens": 0, "llm_time": 0.0}, table)


@dataclass
class BaselineEngine(Engine):
    """Raw regexes, whole files, no absorption; JSON keys from all lines."""

    style: str = "regex"
    consolidate: bool = False
    json_sample: int | None = None

    def read(self, path: str) -> DataFrame:
        return sources.read_whole(self.spark, path)


ENGINES: dict[str, type[Engine]] = {"wifi_log_parser": Engine, "log_extractor": BaselineEngine}
DEFAULT = "wifi_log_parser"


def list_supported_engines() -> list[str]:
    return sorted(ENGINES)


def get_engine_name(name: str | None = None) -> str:
    chosen = (name or DEFAULT).strip().lower()
    if chosen not in ENGINES:
        raise ValueError(f"unknown engine {chosen}; there are {', '.join(list_supported_engines())}")
    return chosen


def get_engine(name: str | None = None) -> type[Engine]:
    return ENGINES[get_engine_name(name)]


def register(name: str, engine: type[Engine]) -> None:
    ENGINES[name.strip().lower()] = engine
