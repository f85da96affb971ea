"""Settings of a node: a small YAML subset, environment and flags, checked."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


# Defaults of a node and of a client.
@dataclass(frozen=True)
class NodeSettings:
    node_id: int = 1
    role: str = "standalone"
    host: str = "0.0.0.0"
    port: int = 9000
    threads: int = 4
    replication_port: int = 0
    data_dir: str = "data"
    cache_size: int = 1000
    log_level: str = "info"
    peers: tuple[tuple[str, int], ...] = field(default=())


@dataclass(frozen=True)
class ClientSettings:
    host: str = "localhost"
    port: int = 9000
    timeout: str = "30s"
    format: str = "text"
    data_dir: str = str(Path.home() / ".tidemark" / "data")


_PLACES = {
    ("node", "id"): "node_id", ("node", "role"): "role", ("server", "host"): "host", ("server", "port"): "port", ("server", "threads"): "threads",
    ("replication", "port"): "replication_port", ("storage", "data_dir"): "data_dir", ("storage", "cache_size"): "cache_size", ("logging", "level"): "log_level",
}


def unquote(text: str) -> str:
    """Without outer blanks, then without one pair of double quotes."""
    text = text.strip(" \t\r\n")
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == '"' else text


def unquoted(text: Column) -> Column:
    """``unquote`` as a column expression."""
    bare = F.btrim(text, F.lit(" \t\r\n"))
    return F.when((F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"'), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def parse_sections(text: str) -> tuple[dict[tuple[str, str], str], list[dict[str, str]]]:
    """Values by section and key, and the items of the list ``peers``. Comments and lines without a colon are skipped."""
    values: dict[tuple[str, str], str] = {}
    peers: list[dict[str, str]] = []
    section = ""
    for line in text.splitlines():
        bare = line.strip(" \t\r\n")
        if not bare or bare[0] == "#" or ":" not in bare:
            continue
        item = bare.startswith("-")
        key, _, value = bare.removeprefix("-").partition(":")
        key, value = key.strip(), unquote(value)
        if not item and not value and line[:1] not in " \t":
            section = key
        elif section == "peers":
            if item:
                peers.append({})
            if peers:
                peers[-1][key] = value
        else:
            values[section, key] = value
    return values, peers


def _typed(cls: type, given: dict[str, object]) -> dict[str, object]:
    kinds = {f.name: type(f.default) for f in fields(cls) if f.name != "peers"}
    unknown = set(given) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {k: kinds[k](v) for k, v in given.items()}


def node_settings(path: str | None = None, **flags: object) -> NodeSettings:
    """Settings from a file, overridden by flags that aren't None. Raises on ports out of range and unknown roles."""
    out = NodeSettings()
    if path:
        values, peers = parse_sections(Path(path).read_text())
        out = replace(out, **_typed(NodeSettings, {name: values[place] for place, name in _PLACES.items() if values.get(place)}))
        out = replace(out, peers=tuple((p["host"], int(p["port"])) for p in peers if p.get("host") and p.get("port")))
    out = replace(out, **_typed(NodeSettings, {k: v for k, v in flags.items() if v is not None}))
    if not 0 < out.port < 65536 or not 0 <= out.replication_port < 65536:
        raise ValueError("a port is out of range")
    if out.role not in ("leader", "follower", "standalone"):
        raise ValueError(f"unknown role {out.role!r}")
    return out


#: Where a client's settings lie if no other file is named.
CLIENT_FILE = Path.home() / ".tidemark" / "client.yaml"


def create_client_settings(path: Path = CLIENT_FILE) -> bool:
    """Write the default settings to ``path`` unless it is there; whether it was written."""
    if path.exists():
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{f.name}: {getattr(ClientSettings(), f.name)}\n" for f in fields(ClientSettings)))
    return True


def client_settings(path: str | None = None, environment: dict[str, str] | None = None) -> ClientSettings:
    """Settings from a flat file (``CLIENT_FILE`` if none is named), then from ``KV_*`` in the environment."""
    given: dict[str, object] = {}
    path = path or str(CLIENT_FILE)
    if path and Path(path).exists():
        values, _ = parse_sections(Path(path).read_text())
        given |= {k: v for (_, k), v in values.items() if v and k in {f.name for f in fields(ClientSettings)}}
    for f in fields(ClientSettings):
        if v := (os.environ if environment is None else environment).get(f"KV_{f.name.upper()}"):
            given[f.name] = v
    out = replace(ClientSettings(), **_typed(ClientSettings, given))
    if not 0 < out.port < 65536 or out.format not in ("text", "json"):
        raise ValueError("port or format is not allowed")
    return out
