"""Calls to models from tasks: several at once, and what fails kept as a value of its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: Replies to prompts, one each.
Complete = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Calls:
    """workers: calls that a task makes at once. fail_fast: a call that fails ends the job; else its
    row has the error and no reply, and all other rows have their replies."""

    workers: int = 1
    fail_fast: bool = True

    def cache_spec(self) -> dict[str, Any]:
        """No result depends on how it was called for."""
        return {}

    def each(self, call: Callable[[Any], Any], of: list[Any]) -> list[tuple[Any, str | None]]:
        """(result, error) of each call, in order; one of the two is None."""

        def one(x: Any) -> tuple[Any, str | None]:
            try:
                return call(x), None
            except Exception as e:
                if self.fail_fast:
                    raise
                return None, f"{type(e).__name__}: {e}"[:1000]

        if self.workers <= 1 or len(of) < 2:
            return [one(x) for x in of]
        with ThreadPoolExecutor(self.workers) as pool:
            try:
                return list(pool.map(one, of))
            except Exception:
                pool.shutdown(cancel_futures=True)  # what hasn't begun isn't called
                raise

    def replies(self, complete: Complete, prompts: list[str], what: str = "replies") -> list[tuple[str | None, str | None]]:
        """Of a model that takes many prompts: all in one call, if nothing is to be kept apart."""
        if self.fail_fast and self.workers <= 1:
            return [(r, None) for r in _as_many(complete(prompts), prompts, what)] if prompts else []
        return self.each(lambda p: _as_many(complete([p]), [p], what)[0], prompts)


def _as_many(got: list[Any], asked: list[Any], what: str) -> list[Any]:
    if len(got) != len(asked):
        raise ValueError(f"{len(asked)} texts gave {len(got)} {what}")
    return got


def replied(rows: DataFrame, complete: Complete, calls: Calls = Calls(), prompt: str = "prompt", reply: str = "reply", live: str | None = None) -> DataFrame:
    """rows with the reply to each prompt, and error, null where there is a reply. live: a folder
    where they can be read as they come; all calls are made at once then."""
    if live is not None:
        from ..sources.live import live_records

        def each(some: list[dict[str, Any]]) -> list[dict[str, Any]]:
            return [r | {reply: said, "error": e} for r, (said, e) in zip(some, calls.replies(complete, [r[prompt] for r in some]), strict=True)]

        return live_records(rows.drop(reply, "error"), live, each, f"{reply} string, error string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = calls.replies(complete, b[prompt].tolist())
            yield b.assign(**{name: pd.Series([g[k] for g in got], index=b.index, dtype=object) for k, name in enumerate((reply, "error"))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in (reply, "error"))
    return rows.drop(reply, "error").mapInPandas(run, f"{kinds}, {reply} string, error string")
