"""The run checkpoint: a few rows with transactions, in SQLite on the driver.

Everything that grows with data is a table in Spark (see ``cache``); only scopes and runs are here,
as advancing a checkpoint needs compare-and-swap.
"""

from __future__ import annotations

import sqlite3
from contextlib import closing

SCHEMA = """
CREATE TABLE IF NOT EXISTS scopes (scope_hash TEXT PRIMARY KEY, base_sha TEXT NOT NULL, generation INTEGER NOT NULL DEFAULT 0);
CREATE TABLE IF NOT EXISTS runs (run_id TEXT PRIMARY KEY, scope_hash TEXT NOT NULL, base_sha TEXT NOT NULL, target_sha TEXT NOT NULL, generation INTEGER NOT NULL, status TEXT NOT NULL);
CREATE UNIQUE INDEX IF NOT EXISTS one_open_run ON runs (scope_hash) WHERE status IN ('running', 'pending');
CREATE UNIQUE INDEX IF NOT EXISTS one_commit_of_range ON runs (scope_hash, base_sha, target_sha, generation) WHERE status = 'committed';
CREATE TABLE IF NOT EXISTS units (run_id TEXT, unit_id TEXT, digest TEXT, status TEXT, attempts INTEGER DEFAULT 0, PRIMARY KEY (run_id, unit_id));
CREATE TABLE IF NOT EXISTS audit (at INTEGER PRIMARY KEY AUTOINCREMENT, scope_hash TEXT, what TEXT, before_sha TEXT, after_sha TEXT);
"""


class Conflict(Exception):
    """The checkpoint or run isn't in the state that the caller expects."""


class Store:
    def __init__(self, path: str):
        self.path = path
        with closing(self._open()) as db:
            db.executescript(SCHEMA)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, isolation_level="IMMEDIATE")

    def _one(self, db: sqlite3.Connection, sql: str, *values) -> None:
        if db.execute(sql, values).rowcount != 1:
            raise Conflict(sql.split()[0:3])

    def base(self, scope: str) -> str | None:
        with closing(self._open()) as db:
            row = db.execute("SELECT base_sha FROM scopes WHERE scope_hash = ?", (scope,)).fetchone()
        return row[0] if row else None

    def initialise(self, scope: str, sha: str) -> None:
        with closing(self._open()) as db, db:
            db.execute("INSERT INTO scopes (scope_hash, base_sha) VALUES (?, ?)", (scope, sha))
            db.execute("INSERT INTO audit (scope_hash, what, after_sha) VALUES (?, 'init', ?)", (scope, sha))

    def begin(self, run: str, scope: str, target: str) -> None:
        """Open a run from the checkpoint to a target; a scope has one open run at most."""
        with closing(self._open()) as db, db:
            try:
                self._one(db, "INSERT INTO runs SELECT ?, scope_hash, base_sha, ?, generation, 'running' FROM scopes WHERE scope_hash = ?", run, target, scope)
            except sqlite3.IntegrityError as error:
                raise Conflict("an open run") from error

    def advance(self, run: str) -> None:
        """Commit a run and move the checkpoint from the run's base to its target, if it is still there."""
        with closing(self._open()) as db, db:
            row = db.execute("SELECT scope_hash, base_sha, target_sha FROM runs WHERE run_id = ? AND status = 'running'", (run,)).fetchone()
            if row is None:
                raise Conflict("no running run")
            self._one(db, "UPDATE scopes SET base_sha = ? WHERE scope_hash = ? AND base_sha = ?", row[2], row[0], row[1])
            self._one(db, "UPDATE runs SET status = 'committed' WHERE run_id = ?", run)
            db.execute("INSERT INTO audit (scope_hash, what, before_sha, after_sha) VALUES (?, 'advance', ?, ?)", row)

    def close(self, run: str, status: str) -> None:
        """End a run without moving the checkpoint: blocked, abandoned or review_required."""
        with closing(self._open()) as db, db:
            self._one(db, "UPDATE runs SET status = ? WHERE run_id = ? AND status IN ('running', 'pending')", status, run)

    def rebaseline(self, scope: str, expected: str, sha: str) -> None:
        """Set the checkpoint by hand; a new generation begins."""
        with closing(self._open()) as db, db:
            self._one(db, "UPDATE scopes SET base_sha = ?, generation = generation + 1 WHERE scope_hash = ? AND base_sha = ?", sha, scope, expected)
            db.execute("INSERT INTO audit (scope_hash, what, before_sha, after_sha) VALUES (?, 'rebaseline', ?, ?)", (scope, expected, sha))

    def unit(self, run: str, unit: str, digest: str, status: str) -> None:
        with closing(self._open()) as db, db:
            db.execute(
                "INSERT INTO units VALUES (?, ?, ?, ?, 1) ON CONFLICT (run_id, unit_id) DO UPDATE SET digest = excluded.digest, status = excluded.status, attempts = attempts + 1",
                (run, unit, digest, status),
            )

    def recover(self) -> int:
        """Units that a crash left in flight become unknown; returns how many."""
        with closing(self._open()) as db, db:
            return db.execute("UPDATE units SET status = 'unknown' WHERE status = 'in_flight'").rowcount

    def status(self, scope: str) -> dict[str, int]:
        with closing(self._open()) as db:
            row = db.execute(
                "SELECT count(*) FILTER (WHERE r.status IN ('running', 'pending')), count(*) FILTER (WHERE r.status = 'committed') FROM runs r WHERE scope_hash = ?", (scope,)
            ).fetchone()
            units = db.execute("SELECT count(*), coalesce(sum(attempts), 0) FROM units JOIN runs USING (run_id) WHERE scope_hash = ? AND units.status NOT IN ('done')", (scope,)).fetchone()
        return {"open_runs": row[0], "committed_runs": row[1], "open_units": units[0], "attempts": units[1]}
