"""A client's view of a store: get, set, delete, status, a shell, and how results are shown.

``python -m tidemark --path FOLDER get KEY`` runs one command; without ``--path`` the
data lies in the folder that the settings name (``data_dir``), and stays there.
"""

from __future__ import annotations

import json
import sys
from argparse import ArgumentParser
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import wire
from tidemark.plans.store import Store
from tidemark.sources.settings import CLIENT_FILE, client_settings, create_client_settings


class Client:
    """Single-key calls on a store. Each runs a Spark job; use DataFrames for many keys."""

    def __init__(self, spark: SparkSession, path: str, role: str = "leader") -> None:
        self.store, self.role = Store(spark, path), role

    def get(self, key: str) -> str | None:
        row = self.store.get(key).first()
        return None if row is None else row.value

    def set(self, key: str, value: str) -> None:
        self._may_write()
        self.store.put(key, value)

    def delete(self, key: str) -> bool:
        """Whether the key was live; the removal is written in any case."""
        self._may_write()
        return self.store.delete(key)

    def _may_write(self) -> None:
        if self.role == "follower":
            raise PermissionError(wire.NOT_LEADER)

    def ping(self) -> str:
        return wire.PONG

    def status(self) -> dict[str, object]:
        s = self.store.state
        return {"role": self.role.upper(), "version": self.store.version, "next_seq": s["next_seq"], "runs": len(s["runs"]), "segments": len(s["segments"])}

    def call(self, line: str) -> str:
        """One line of the shell: ``put("k","v")``, ``get("k")``, ``delete("k")``, ``ls``, ``flush``, ``clear``."""
        spark = self.store.spark
        verb, key, value = spark.createDataFrame([(line,)], "line string").select(wire.parse_call(F.col("line")).alias("c")).first().c
        if verb == "PUT":
            self.set(key, value)
        elif verb == "GET":
            got = self.get(key)
            return wire.NOT_FOUND if got is None else got
        elif verb == "DELETE":
            return wire.DELETED if self.delete(key) else wire.DELETE_FAILED
        elif verb == "LS":
            return "\n".join(f"{r.source} {r.key} = {r.value} [{r.seq}]" for r in self.store.listing().toLocalIterator())
        elif verb == "FLUSH":
            self.store.flush()
        elif verb == "CLEAR":
            self.store.clear()
        else:
            return "ERROR"
        return "OK"


def show_value(key: str, value: str | None, form: str = "text") -> str:
    """A result as text (JSON values indented) or as one JSON object."""
    try:
        parsed = json.loads(value) if value is not None else None
        is_json = value is not None
    except ValueError:
        parsed, is_json = value, False
    if form == "json":
        shown = {"success": False, "error": "key not found", "key": key} if value is None else {"success": True, "key": key, "value": parsed}
        return json.dumps(shown, indent=2, ensure_ascii=False)
    if value is None:
        return f"Key not found: {key}"
    return json.dumps(parsed, indent=2, ensure_ascii=False) if is_json else value


def show_message(message: str, success: bool = True, form: str = "text") -> str:
    if form == "json":
        return json.dumps({"success": success, "message" if success else "error": message}, indent=2)
    return message if success else f"Error: {message}"


def show_rows(df: DataFrame, form: str = "text") -> list[str]:
    """Rows as JSON lines, or tab-separated text; meant for small results."""
    if form == "json":
        return [r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    return ["\t".join("" if v is None else str(v) for v in r) for r in df.toLocalIterator()]


def main(args: list[str] | None = None) -> int:
    p = ArgumentParser(prog="tidemark")
    p.add_argument("--path")
    p.add_argument("--config")
    p.add_argument("--format", choices=("text", "json"))
    p.add_argument("command", choices=("get", "set", "delete", "del", "rm", "ping", "status", "config", "shell"))
    p.add_argument("words", nargs="*", help="key and value; for config: show (the default) or init")
    a = p.parse_args(args)
    settings = client_settings(a.config)
    form = a.format or settings.format
    if a.command == "config":
        if a.words == ["init"]:
            file = Path(a.config) if a.config else CLIENT_FILE
            print(f"{'created' if create_client_settings(file) else 'already there'}: {file}")
            return 0
        if a.words not in ([], ["show"]):
            p.error("config takes show or init")
        print(json.dumps(vars(settings), indent=2))
        return 0
    wanted = {"get": 1, "set": 2, "delete": 1, "del": 1, "rm": 1}.get(a.command, 0)
    if len(a.words) != wanted:
        p.error(f"{a.command} takes {wanted} words")
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    client = Client(spark, a.path or Path(settings.data_dir).absolute().as_uri())
    if a.command == "get":
        value = client.get(a.words[0])
        print(show_value(a.words[0], value, form))
        return int(value is None)
    if a.command == "set":
        client.set(*a.words)
        print(show_message(wire.STORED, form=form))
    elif a.command in ("delete", "del", "rm"):
        live = client.delete(a.words[0])
        print(show_message(wire.DELETED if live else wire.DELETE_FAILED, live, form))
        return int(not live)
    elif a.command == "ping":
        print(show_message(client.ping(), form=form))
    elif a.command == "status":
        print(json.dumps(client.status(), indent=2))
    else:
        for line in sys.stdin:
            print(client.call(line.rstrip("\n")), flush=True)
    return 0
