"""DDL text for PostgreSQL-like databases, MySQL, DaMeng and Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .defaults import clean_default
from .typemap import Column, map_type, spark_type

_BITS = re.compile(r"[bB]'([01]*)'")
_UUID = re.compile(r"\bgen_random_uuid\s*\(\s*\)", re.I)


@dataclass(frozen=True)
class Table:
    name: str
    columns: list[Column]


@dataclass(frozen=True)
class Index:
    table: str
    name: str
    columns: list[str]
    unique: bool = False
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    table: str
    name: str
    columns: list[str]
    ref_table: str
    ref_columns: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass
class Dialect:
    """One target: how names are quoted, types mapped and statements put together."""

    name: str
    quote: str = '"'
    end: str = ""
    fold: Callable[[str], str] = str
    uuid: str = "gen_random_uuid()"
    caps: dict[str, bool] = field(default_factory=dict)

    def q(self, ident: str) -> str:
        ident = self.fold(ident)
        return f"`{ident.replace('`', '``')}`" if self.quote == "`" else f'"{ident}"'

    def table(self, schema: str, table: str) -> str:
        return f"{self.q(schema)}.{self.q(table)}" if schema else self.q(table)

    def cols(self, names: list[str]) -> str:
        return ", ".join(map(self.q, names))

    def type_of(self, src: str, c: Column, **opt: bool) -> str:
        return map_type(src, self.name, c, **opt)

    # Parts that differ between targets

    def default(self, c: Column, src: str, target_type: str) -> str:
        raise NotImplementedError

    def column(self, c: Column, src: str, **opt: bool) -> str:
        raise NotImplementedError

    def create_table(self, schema: str, t: Table, src: str, name: Callable[[str], str] = str, **opt: bool) -> list[str]:
        raise NotImplementedError

    def view(self, schema: str, name: str, body: str) -> str:
        return f"CREATE OR REPLACE VIEW {self.table(schema, name)} AS {body}{self.end}"

    def adjust_view(self, body: str) -> str:
        return _UUID.sub(self.uuid, body)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Defaults that are calls or keywords, by target.
_PG_WORDS = {"CURRENT_TIMESTAMP": "CURRENT_TIMESTAMP", "NOW()": "CURRENT_TIMESTAMP", "GETDATE()": "CURRENT_TIMESTAMP", "CURRENT_DATE": "CURRENT_DATE", "CURRENT_TIME": "CURRENT_TIME", "NULL": "NULL", "TRUE": "TRUE", "FALSE": "FALSE"}
_DM_WORDS = {
    **dict.fromkeys(("CURRENT_TIMESTAMP", "NOW()", "PG_SYSTIMESTAMP()", "CLOCK_TIMESTAMP()", "STATEMENT_TIMESTAMP()", "TRANSACTION_TIMESTAMP()", "LOCALTIMESTAMP", "LOCALTIMESTAMP()", "SYSTIMESTAMP"), "CURRENT_TIMESTAMP"),
    **dict.fromkeys(("CURRENT_DATE", "LOCALDATE", "SYSDATE"), "CURRENT_DATE"), **dict.fromkeys(("CURRENT_TIME", "LOCALTIME", "LOCALTIME()"), "CURRENT_TIME"), "NULL": "NULL", "TRUE": "1", "FALSE": "0",
}
_MY_NOW = ("CURRENT_TIMESTAMP", "NOW()", "SYSDATE", "GETDATE()", "CURRENT_DATE")
_MY_WORDS = {"NULL": "NULL", "TRUE": "1", "FALSE": "0", **dict.fromkeys(("SYS_GUID()", "NEWID()", "UUID()", "USER", "USER()"), "NULL")}


class Postgres(Dialect):
    def default(self, c: Column, src: str, target_type: str) -> str:
        text = clean_default(src, c.default or "")
        word = text.strip().upper()
        if m := _BITS.fullmatch(text):
            return f" DEFAULT B'{m[1]}'"
        if word in ("NEWID()", "UUID()"):
            return f" DEFAULT {self.uuid}"
        if word in _PG_WORDS:
            return f" DEFAULT {_PG_WORDS[word]}"
        return f" DEFAULT {text}" if word.endswith(")") else f" DEFAULT {_literal(text)}"

    def column(self, c: Column, src: str, **opt: bool) -> str:
        text = f"{self.q(c.name)} {self.type_of(src, c, **opt)}" + ("" if c.nullable else " NOT NULL")
        return text + (self.default(c, src, "") if c.default is not None and c.extra != "auto_increment" else "")

    def create_table(self, schema: str, t: Table, src: str, name: Callable[[str], str] = str, **opt: bool) -> list[str]:
        at = self.table(schema, name(t.name))
        body = ",\n".join("  " + self.column(_named(c, name), src, **opt) for c in t.columns)
        return [f"DROP TABLE IF EXISTS {at} CASCADE;\nCREATE TABLE {at} (\n{body}\n);"]

    def sequence(self, schema: str, table: str, column: str, start: int) -> list[str]:
        seq, at = self.table(schema, f"seq_{table}_{column}"), self.table(schema, table)
        return [f"CREATE SEQUENCE IF NOT EXISTS {seq} INCREMENT BY 1 START {start}", f"ALTER TABLE {at} ALTER COLUMN {self.q(column)} SET DEFAULT nextval('{seq}')", f"ALTER SEQUENCE {seq} OWNED BY {at}.{self.q(column)}"]

    def index(self, schema: str, i: Index) -> str:
        at = self.table(schema, i.table)
        if i.primary:
            return f"ALTER TABLE {at} ADD PRIMARY KEY ({self.cols(i.columns)});"
        return f"CREATE {'UNIQUE ' * i.unique}INDEX IF NOT EXISTS {self.q(i.name)} ON {at} ({self.cols(i.columns)});"

    def foreign_key(self, schema: str, k: ForeignKey) -> str:
        return f"ALTER TABLE {self.table(schema, k.table)} ADD CONSTRAINT {self.q(k.name)} FOREIGN KEY ({self.cols(k.columns)}) REFERENCES {self.table(schema, k.ref_table)} ({self.cols(k.ref_columns)}) ON DELETE {k.on_delete} ON UPDATE {k.on_update};"

    def comment(self, schema: str, table: str, column: str, text: str) -> list[str]:
        at = self.table(schema, table)
        return [f"COMMENT ON {'COLUMN' if column else 'TABLE'} {at}{'.' + self.q(column) if column else ''} IS {_literal(text)};"]


class MySql(Dialect):
    def default(self, c: Column, src: str, target_type: str) -> str:
        text = clean_default(src, c.default or "")
        if not text:
            return ""
        word, kind = text.strip().upper(), target_type.lower()
        if word in _MY_NOW:
            return " DEFAULT CURRENT_TIMESTAMP" if kind.startswith(("datetime", "timestamp")) else " DEFAULT NULL"
        if word in _MY_WORDS:
            return f" DEFAULT {_MY_WORDS[word]}"
        if m := _BITS.fullmatch(text):
            return f" DEFAULT {int(m[1] or '0', 2)}"
        if any(x in kind for x in ("text", "blob", "json", "geometry")):
            return ""
        if re.fullmatch(r"\s*[-+]?\d*\.?\d*\s*", text):
            return f" DEFAULT {text}"
        return " DEFAULT NULL" if word.endswith(")") else f" DEFAULT {_literal(text)}"

    def column(self, c: Column, src: str, **opt: bool) -> str:
        kind = self.type_of(src, c, **opt)
        text = f"{self.q(c.name)} {kind}" + ("" if c.nullable else " NOT NULL")
        if c.extra == "auto_increment":
            return text + " AUTO_INCREMENT"
        return text + (self.default(c, src, kind) if c.default is not None else "")

    def create_table(self, schema: str, t: Table, src: str, name: Callable[[str], str] = str, **opt: bool) -> list[str]:
        at = self.table(schema, name(t.name))
        body = ",\n".join("  " + self.column(_named(c, name), src, **opt) for c in t.columns)
        return [f"DROP TABLE IF EXISTS {at}", f"CREATE TABLE {at} (\n{body}\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4"]

    def sequence(self, schema: str, table: str, column: str, start: int) -> list[str]:
        return [f"ALTER TABLE {self.table(schema, table)} AUTO_INCREMENT = {max(start, 1)}"]

    def index(self, schema: str, i: Index) -> str:
        what = "PRIMARY KEY" if i.primary else f"{'UNIQUE ' * i.unique}INDEX {self.q(i.name)}"
        return f"ALTER TABLE {self.table(schema, i.table)} ADD {what} ({self.cols(i.columns)})"

    def foreign_key(self, schema: str, k: ForeignKey) -> str:
        text = f"ALTER TABLE {self.table(schema, k.table)} ADD CONSTRAINT {self.q(k.name)} FOREIGN KEY ({self.cols(k.columns)}) REFERENCES {self.table(schema, k.ref_table)} ({self.cols(k.ref_columns)})"
        for event, action in (("DELETE", k.on_delete), ("UPDATE", k.on_update)):
            if (a := action.strip().upper()) not in ("", "NO ACTION", "RESTRICT"):
                text += f" ON {event} {a}"
        return text

    def comment(self, schema: str, table: str, column: str, text: str) -> list[str]:
        return [] if column else [f"ALTER TABLE {self.table(schema, table)} COMMENT = {_literal(text)}"]


class DaMeng(Dialect):
    def default(self, c: Column, src: str, target_type: str) -> str:
        text = clean_default(src, c.default or "")
        if not text:
            return ""
        word = text.strip().upper()
        if word in _DM_WORDS:
            return f" DEFAULT {_DM_WORDS[word]}"
        if m := _BITS.fullmatch(text):
            return f" DEFAULT {int(m[1] or '0', 2)}"
        return f" DEFAULT {text}" if word.endswith(")") else f" DEFAULT {_literal(text)}"

    def column(self, c: Column, src: str, **opt: bool) -> str:
        auto = c.extra == "auto_increment"
        text = f"{self.q(c.name)} {self.type_of(src, c, **opt)}" + " IDENTITY(1, 1)" * auto + ("" if c.nullable else " NOT NULL")
        return text + (self.default(c, src, "") if c.default is not None and not auto else "")

    def create_table(self, schema: str, t: Table, src: str, name: Callable[[str], str] = str, **opt: bool) -> list[str]:
        at = self.table(schema, name(t.name))
        body = ",\n".join("  " + self.column(_named(c, name), src, **opt) for c in t.columns)
        return [f"DROP TABLE {at} CASCADE CONSTRAINTS", f"CREATE TABLE {at} (\n{body}\n)"]

    def sequence(self, schema: str, table: str, column: str, start: int) -> list[str]:
        return [f"ALTER TABLE {self.table(schema, table)} ALTER COLUMN {self.q(column)} RESTART WITH {start}"]

    def index(self, schema: str, i: Index) -> str:
        at = self.table(schema, i.table)
        if i.primary:
            return f"ALTER TABLE {at} ADD PRIMARY KEY ({self.cols(i.columns)})"
        return f"CREATE {'UNIQUE ' * i.unique}INDEX {self.q(i.table + '_' + i.name)} ON {at} ({self.cols(i.columns)})"

    def foreign_key(self, schema: str, k: ForeignKey) -> str:
        action = k.on_delete.strip().upper()
        tail = f" ON DELETE {action}" if action not in ("", "NO ACTION") else ""
        return f"ALTER TABLE {self.table(schema, k.table)} ADD CONSTRAINT {self.q(k.name)} FOREIGN KEY ({self.cols(k.columns)}) REFERENCES {self.table(schema, k.ref_table)} ({self.cols(k.ref_columns)}){tail}"

    def comment(self, schema: str, table: str, column: str, text: str) -> list[str]:
        at = self.table(schema, table)
        return [f"COMMENT ON {'COLUMN' if column else 'TABLE'} {at}{'.' + self.q(column) if column else ''} IS {_literal(text)}"]


class SparkSql(Dialect):
    """Spark tables: types of spark_type(), no keys or sequences; the default stands as a table property."""

    def type_of(self, src: str, c: Column, **opt: bool) -> str:
        return spark_type(src, c).simpleString()

    def column(self, c: Column, src: str, **opt: bool) -> str:
        return f"{self.q(c.name)} {self.type_of(src, c)}" + ("" if c.nullable else " NOT NULL")

    def create_table(self, schema: str, t: Table, src: str, name: Callable[[str], str] = str, **opt: bool) -> list[str]:
        at = self.table(schema, name(t.name))
        body = ",\n".join("  " + self.column(_named(c, name), src) for c in t.columns)
        return [f"DROP TABLE IF EXISTS {at}", f"CREATE TABLE {at} (\n{body}\n) USING parquet"]


def _named(c: Column, name: Callable[[str], str]) -> Column:
    return Column(name(c.name), c.data_type, c.length, c.precision, c.scale, c.nullable, c.default, c.extra)


_PG_CAPS = {"sequences": True, "change_owner": True}
DIALECTS: dict[str, Dialect] = {
    "postgres": Postgres("postgres", end=";", caps=_PG_CAPS), "gaussdb": Postgres("gaussdb", end=";", uuid="uuid()", caps=_PG_CAPS | {"distribute": True}),
    "seabox": Postgres("seabox", end=";", uuid="sys_guid()", caps=_PG_CAPS), "highgo": Postgres("highgo", end=";", caps=_PG_CAPS | {"distribute": True}),
    "kingbase": Postgres("kingbase", end=";", caps=_PG_CAPS | {"distribute": True}), "mysql": MySql("mysql", quote="`", uuid="uuid()"),
    "dameng": DaMeng("dameng", fold=str.upper, uuid="sys_guid()", caps={"identity_insert": True}), "spark": SparkSql("spark", quote="`", uuid="uuid()"),
}


def distribute(dialect: str, schema: str, table: str, keys: list[str]) -> str:
    """Hash distribution by key where the target has it, else ''."""
    d = DIALECTS[dialect]
    return f"ALTER TABLE {d.table(schema, table)} DISTRIBUTE BY HASH({d.cols(keys)})" if d.caps.get("distribute") and keys else ""
