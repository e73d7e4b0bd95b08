"""Drift with memory as a stream: what a note was worth before it broke, kept for each slug until it is whole again.

Each row of the stream is a note looked at in a run. State is keyed by slug: the confidence that the note holds, and the memory of a
demotion (the confidence before, the commit, the citation, the day). A note that stays broken keeps its first memory; one that comes back clean takes it and
forgets it. Runs come in order for a slug; a run that was seen before, or an older one, changes nothing and gives no row, so a batch
that is replayed is harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOOKS = "slug string, run long, confidence string, broken boolean, ref string, sha string, day string"
STATE = "run long, held string, edited string, prior string, sha string, ref string, day string"
MOVES = "slug string, run long, action string, confidence string, remembered string, from_sha string, sha string, line string"


def looks(notes: DataFrame, findings: DataFrame) -> DataFrame:
    """LOOKS of a batch or a stream of runs. notes: slug, run, confidence, sha, day; findings: slug, run, pos, verdict, ref."""
    first = F.min_by(F.when(F.col("verdict") == "broken", F.col("ref")), F.when(F.col("verdict") == "broken", F.col("pos")))
    per = findings.groupBy("slug", "run").agg(F.bool_or(F.col("verdict") == "broken").alias("broken"), first.alias("ref"))
    return notes.join(per, ["slug", "run"]).select("slug", "run", "confidence", "broken", "ref", "sha", "day")


class Memory(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("note", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (slug,) = key
        batch = pd.concat(list(rows)).sort_values("run", kind="stable")  # the runs of one note in one batch
        run, held, edited, prior, sha, ref, day = self.state.get() if self.state.exists() else (None,) * 7
        out = []
        for look in batch.itertuples(index=False):
            if run is not None and look.run <= run:
                continue
            run = int(look.run)
            told = None if pd.isna(look.confidence) else look.confidence
            if edited is None or told != edited:  # the note says something new: its author's word holds
                held = edited = told
            action, source, line = "stamped", None, None
            if look.broken and held not in (None, "", "low") and prior is None:
                action, prior, sha, ref, day = "demoted", held, look.sha, look.ref, look.day
                line = f"demote {slug} at {look.sha} ref={look.ref} confidence={held}->low"
                held = "low"
            elif not look.broken and prior is not None:
                action, source, line = "restored", sha, f"restore {slug} {sha} -> {look.sha} confidence=low->{prior}"
                held, prior, sha, ref, day = prior, None, None, None, None
            out.append((slug, run, action, held, prior, source, look.sha, line))
        self.state.update((run, held, edited, prior, sha, ref, day))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVES.split(", ")]).astype({"run": "int64"})

    def close(self) -> None:
        pass


def remembered(stream: DataFrame) -> DataFrame:
    """MOVES of a stream of LOOKS: a row for each new look at a note. Append mode; the state store must be RocksDB's."""
    return stream.groupBy("slug").transformWithStateInPandas(statefulProcessor=Memory(), outputStructType=MOVES, outputMode="Append", timeMode="None")
