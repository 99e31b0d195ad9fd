"""Schema configuration in JSON: tables, columns and relationships."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

from tablewright.plans.spec import PlanError, Relationship, as_tuple


@dataclass(frozen=True)
class TableConfig:
    name: str
    columns: Mapping[str, Mapping]
    key: tuple[str, ...] = ()
    physical: str | None = None


@dataclass(frozen=True)
class Config:
    tables: Mapping[str, TableConfig]
    links: tuple[Mapping, ...]
    rules: tuple[Mapping, ...] = ()

    def columns(self) -> dict[str, list[str]]:
        return {name: list(t.columns) for name, t in self.tables.items()}

    def table_for(self, physical: str) -> str:
        """Logical name of a physical table, exact match only."""
        for name, t in self.tables.items():
            if physical in (name, t.physical):
                return name
        raise PlanError(f"no table is bound to {physical!r}")

    def target(self) -> tuple[str, str] | None:
        """Table and column flagged as the target."""
        for name, t in self.tables.items():
            for column, info in t.columns.items():
                if info.get("is_target"):
                    return name, column
        return None

    def relationships(self, main: str, present: Iterable[str] | None = None) -> list[Relationship]:
        """Relations to the main table, in either direction, with both tables present.

        Without declared relations, columns flagged as join keys that share the
        name of a main key column are used.
        """
        known = set(self.tables if present is None else present)
        out = []
        for link in self.links:
            a, b = link["from_table"], link["to_table"]
            if not {a, b} <= known or main not in (a, b):
                continue
            ka, kb = as_tuple(link["from_key"]), as_tuple(link["to_key"])
            side, key, main_key = (a, ka, kb) if b == main else (b, kb, ka)
            out.append(
                Relationship(
                    side,
                    key,
                    main_key,
                    unique=link.get("type") == "one_to_one",
                    time_column=self.time_column(side),
                    description=link.get("description", ""),
                )
            )
        if out or self.links or len(known) < 2:
            return out
        keys = {c for c, info in self.tables[main].columns.items() if info.get("is_join_key") or c in self.tables[main].key}
        for name in sorted(known - {main}):
            for column, info in self.tables[name].columns.items():
                if column in keys and (info.get("is_join_key") or info.get("is_foreign_key")):
                    out.append(Relationship(name, column, column, time_column=self.time_column(name)))
                    break
        return out

    def time_column(self, table: str) -> str | None:
        """The column declared to hold days relative to the sample date, or the event time."""
        for column, info in self.tables[table].columns.items():
            if info.get("time_relative") or info.get("is_event_time"):
                return column
        return None


def parse_config(raw: Mapping) -> Config:
    """Check the configuration and turn it into objects. Every problem is reported at once."""
    problems = [f"no {part!r} section" for part in ("tables", "relationships") if part not in raw]
    if problems:
        raise PlanError("; ".join(problems))
    tables = {}
    for name, info in raw["tables"].items():
        fields = info.get("fields") or info.get("columns") or {}
        columns = {c: {} for c in fields} if isinstance(fields, list) else dict(fields)
        key = as_tuple(info.get("primary_key"))
        problems += [f"{name}: key column {c!r} is not declared" for c in key if columns and c not in columns]
        tables[name] = TableConfig(name, columns, key, info.get("physical_table"))
    links = []
    for i, rel in enumerate(raw["relationships"]):
        link = {
            "from_table": rel.get("from_table") or rel.get("from_entity"),
            "to_table": rel.get("to_table") or rel.get("to_entity"),
            "from_key": rel.get("from_key") or rel.get("from_field"),
            "to_key": rel.get("to_key") or rel.get("to_field"),
            "type": rel.get("type", "many_to_one"),
            "description": rel.get("description", ""),
        }
        problems += [f"relationship {i}: no {k}" for k, v in link.items() if v is None]
        problems += [
            f"relationship {i}: unknown table {link[e]!r}"
            for e in ("from_table", "to_table")
            if link[e] is not None and link[e] not in tables
        ]
        links.append(link)
    if problems:
        raise PlanError("; ".join(problems))
    return Config(tables, tuple(links), tuple(raw.get("business_rules", ())))


def load_config(path: str) -> Config:
    """Read the configuration on the driver."""
    return parse_config(json.loads(Path(path).read_text(encoding="utf-8")))
