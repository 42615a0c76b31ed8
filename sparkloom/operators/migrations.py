"""Ordered SQL scripts, each statement once, with a ledger.

Scripts run in the order of their names. The ledger holds a row for every statement that
succeeded and one for every script that is done, so a run after a failure goes on with the
statement that failed, and a run after a success does nothing. A script that has changed
since it ran is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import merge

LEDGER = "id bigint, filename string, step int, sha256 string, applied_at timestamp"
#: Quoted text, comments, or the end of a statement.
_PARTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)


def statements(script: str) -> list[str]:
    """A script's statements: cut at semicolons outside of quotes and comments; comments go."""
    out, now, at = [], "", 0
    for m in _PARTS.finditer(script):
        now += script[at : m.start()]
        at = m.end()
        if m[0] == ";":
            out.append(now)
            now = ""
        elif not m[0].startswith(("--", "/*")):
            now += m[0]
    return [s.strip() for s in [*out, now + script[at:]] if s.strip()]


def applied(spark: SparkSession, ledger: str = "schema_migrations") -> list[str]:
    """The scripts that are done, in the order in which they ran."""
    if not spark.catalog.tableExists(ledger):
        return []
    return [r["filename"] for r in spark.table(ledger).where("step = 0").orderBy("id").select("filename").collect()]


def run(spark: SparkSession, scripts: Mapping[str, str], ledger: str = "schema_migrations") -> list[str]:
    """Bring the tables up to date; returns the scripts that this run finished.

    Step 0 of a script in the ledger says that it is done; its other steps are its statements.
    """
    merge.create_table(spark, ledger, LEDGER)
    rows = spark.table(ledger).select("id", "filename", "step", "sha256").collect()  # a row a statement of the scripts
    done, last = {(r["filename"], r["step"]): r["sha256"] for r in rows}, max((r["id"] for r in rows), default=0)
    finished = []
    for name in sorted(scripts):
        steps = statements(scripts[name])
        whole = _sha(scripts[name])
        if done.get((name, 0), whole) != whole:
            raise ValueError(f"{name} has changed since it ran")
        if (name, 0) in done:
            continue
        for k, sql in enumerate(steps, 1):
            if (name, k) in done:
                if done[name, k] != _sha(sql):
                    raise ValueError(f"statement {k} of {name} has changed since it ran")
                continue
            spark.sql(sql)
            last += 1
            _note(spark, ledger, last, name, k, _sha(sql))
        last += 1
        _note(spark, ledger, last, name, 0, whole)
        finished.append(name)
    return finished


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _note(spark: SparkSession, ledger: str, id_: int, name: str, step: int, sha: str) -> None:
    row = spark.createDataFrame([(id_, name, step, sha)], "id bigint, filename string, step int, sha256 string")
    row.withColumn("applied_at", F.current_timestamp()).coalesce(1).write.mode("append").insertInto(ledger)
