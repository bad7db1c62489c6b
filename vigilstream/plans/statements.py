"""Statements as named plans that read each other's rows, their deployment over one scan, and the splitting of scripts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vigilstream.operators import correlation, counting, windows


@dataclass(frozen=True)
class Statement:
    """A named plan over an event table, or over the rows of the statement that it ``reads``.

    ``window``: reports are made when windows close; otherwise one an event. ``ranking``: the statement counts events for
    this ranking, and all that do are counted together when they are deployed.
    """

    name: str
    build: Callable[[DataFrame], DataFrame]
    window: str | None = None
    fields: tuple[str, ...] = ()
    reads: str | None = None
    ranking: windows.Ranking | None = None


@dataclass
class Registry:
    statements: dict[str, Statement] = field(default_factory=dict)

    def add(self, statement: Statement) -> Statement:
        if statement.name in self.statements:
            raise ValueError(f"statement {statement.name} is there already")
        self.statements[statement.name] = statement
        return statement

    def remove(self, name: str) -> None:
        """Takes a statement out that no other reads."""
        readers = [s.name for s in self.statements.values() if s.reads == name]
        if readers:
            raise ValueError(f"statement {name} is read by {', '.join(readers)}")
        del self.statements[name]

    def order(self) -> Iterator[Statement]:
        """All statements, each after the one that it reads."""
        given: set[str] = set()

        def give(name: str, on_the_way: tuple[str, ...]) -> Iterator[Statement]:
            if name in on_the_way:
                raise ValueError(f"statements read each other: {' -> '.join((*on_the_way, name))}")
            if name not in self.statements:
                raise ValueError(f"statement {on_the_way[-1]} reads {name}, which isn't there")
            if name in given:
                return
            s = self.statements[name]
            if s.reads is not None:
                yield from give(s.reads, (*on_the_way, name))
            given.add(name)
            yield s

        for name in self.statements:
            yield from give(name, ())

    def build(self, name: str, events: DataFrame) -> DataFrame:
        """One statement by itself, with those whose rows it reads."""
        s = self.statements[name]
        return s.build(self.build(s.reads, events) if s.reads is not None else events)

    def rankings(self) -> tuple[windows.Ranking, ...]:
        """Of the statements that rank, in order."""
        return tuple(s.ranking for s in self.order() if s.ranking is not None)

    def deploy(self, events: DataFrame, size: str = windows.WINDOW, n: int = 10, start: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
        """All statements over one table: the counting ones as one plan with one scan, the others by name.

        Windows begin with the first event unless ``start`` says where.
        """
        start = windows.first_event(events, size) if start is None else start
        counted = counting.all_tops(events, size, n, start=start, rankings=self.rankings())
        return counted, {s.name: self.build(s.name, events) for s in self.order() if s.window is None}


def standard(size: str = windows.WINDOW, n: int = 10, start: str = "0 seconds", seconds: int = 60) -> Registry:
    """The rankings, each as a statement that counts and one that ranks its rows, the rate, and the correlation."""
    out = Registry()
    for r in windows.RANKINGS:
        out.add(Statement(f"{r.name}_sum", lambda events, r=r: windows.counts(events, r, size, start=start), size, ("window_start", *r.keys, "scount")))
        out.add(Statement(f"{r.name}_top", lambda rows, r=r: windows.ranked(rows, r.keys, n), size, ("window_start", *r.keys, "scount", "rank"), f"{r.name}_sum", r))
    out.add(Statement("rate", lambda events: windows.rate(events, size, start=start), size, ("window_start", "window_ms", "scount", "rate")))
    out.add(Statement("correlation", lambda events: correlation.correlation(events, seconds), None, ("key", "window_start", "first_event", "last_event", "repeat_count")))
    return out


def split_script(text: str) -> list[str]:
    """Statements that semicolons outside quotes end; lines of ``--`` and statements wholly within ``/* */`` are dropped."""
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("--")]
    out, now, quote = [], [], ""
    for c in "\n".join(lines):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append("".join(now).strip())
            now = []
            continue
        now.append(c)
    out.append("".join(now).strip())
    return [x for x in out if x and not (x.startswith("/*") and x.endswith("*/"))]
