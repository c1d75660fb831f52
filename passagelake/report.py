"""What is told to people: counts, durations, progress, the reading line, results as JSON, logs without note text."""

from __future__ import annotations

import json
import logging
import math
import os
import time

from pyspark.sql import DataFrame

from passagelake import config
from passagelake.schema import SCHEMA


def num(n: float) -> str:
    return f"{n:,}"


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{num(n)} {one if n == 1 else many or one + 's'}"


def two_figures(n: int) -> str:
    """587 as 590, 9214 as 9,200; under 100 as it is."""
    if n < 100:
        return num(n)
    step = 10 ** (int(math.log10(n)) - 1)
    return num(math.floor(n / step + 0.5) * step)


def duration(seconds: float) -> str:
    s = round(seconds)
    if s < 60:
        return plural(s, "second")
    if s < 3600:
        return plural(round(s / 60), "minute")
    return f"{plural(s // 3600, 'hour')} {plural(s % 3600 // 60, 'minute')}" if s % 3600 >= 60 else plural(s // 3600, "hour")


def reading_line(passages: int, words: int, notes: int, note_words: int) -> str:
    hold = "holds" if notes == 1 else "hold"
    return f"Returned about {two_figures(words)} {'word' if words == 1 else 'words'} in {plural(passages, 'passage')}, from {plural(notes, 'note')} that {hold} about {two_figures(note_words)} {'word' if note_words == 1 else 'words'}."


def progress(done: int, total: int, spent: float) -> dict:
    """Percent done, rate and time left, rounded half up."""
    rate = done / spent if spent > 0 and done else None
    return {"percent": math.floor(done / total * 100) if total else 100, "rate": rate, "eta": None if rate is None else math.floor((total - done) / rate + 0.5)}


class Progress:
    """Done, rate and time left of a run, kept in a file that tells who writes it."""

    def __init__(self, path: str, total: int, clock=time.time):
        self.path, self.total, self.clock, self.began = path, total, clock, clock()

    def at(self, done: int) -> dict:
        return {"pid": os.getpid(), "done": done, "total": self.total, **progress(done, self.total, self.clock() - self.began)}

    def save(self, done: int) -> None:
        config.write_atomic(self.path, json.dumps(self.at(done)))


def read_progress(path: str) -> dict | None:
    """The progress of a run whose process is alive."""
    try:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        os.kill(told["pid"], 0)
    except (OSError, ValueError, KeyError):
        return None
    return told


def request_size(rate: float) -> int:
    """Passages of about five seconds of embedding."""
    return max(8, min(128, math.floor(rate * 5 + 0.5)))


def too_many_failures(failed: int, done: int) -> bool:
    """Whether embedding must stop: over twenty notes, or a quarter of those done once eight are."""
    return failed > 20 or (done >= 8 and failed >= done * 0.25)


def unfinished_notice(waiting: int) -> str | None:
    return f"The last sync did not finish: {plural(waiting, 'note')} not indexed yet." if waiting else None


def as_json(found, command: str = "search", warnings: list[str] | None = None) -> str:
    """A search's result as one object; at most most_count rows in each list."""
    rows = lambda df: [json.loads(r) for r in df.orderBy("rank").toJSON().collect()]
    body = {"results": rows(found.meaning), "exactWords": rows(found.exact), "reading": found.reading.first().asDict()}
    return json.dumps({"schema": SCHEMA, "ok": True, "command": command, "warnings": warnings or [], **body}, default=str)


def flagged(passages: DataFrame) -> DataFrame:
    """Where the screen found something: key, line and flag, never the text."""
    from pyspark.sql import functions as F

    from passagelake.functions import screen

    return passages.select("key", "line", F.explode(screen.rules(F.col("text"))).alias("rule"))


def logger(path: str) -> logging.Logger:
    """A log of key=value lines with the home folder as ~."""
    log = logging.getLogger(f"passagelake:{path}")
    if not log.handlers:
        handler = logging.FileHandler(path, encoding="utf-8", delay=True)
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log


def told(log: logging.Logger, event: str, **values) -> None:
    log.info(" ".join([f"event={event}", *[f"{k}={config.tildify(str(v))}" for k, v in values.items()]]))
