"""Type names between databases, and Spark types for them.

Each pair of databases has a table of rules: source type names and a form. Forms are filled from the column's length,
precision and scale; a database family shares one table. DataFrames of columns are mapped by the same forms as expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

PG_FAMILY = ("postgres", "gaussdb", "seabox", "highgo", "kingbase")
MYSQL_VARCHAR, MYSQL_CHAR = 16000, 255


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    length: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    default: str | None = None
    extra: str = ""


# Source type names on the left, target form on the right. Words in braces are forms (see _fill), the rest is literal.
_PG_TEXT = {"char": "{char}", "varchar": "{varchar}"}
RULES: dict[tuple[str, str], dict[str, str]] = {
    ("mysql", "pg"): {
        "tinyint smallint mediumint int year": "int", "bigint": "bigint", "float double decimal numeric": "{decimal}", "char": "{char}", "varchar": "{varchar}",
        "tinytext text mediumtext longtext set": "text", "datetime timestamp": "timestamp", "date": "date", "time": "time",
        "tinyblob blob mediumblob longblob binary varbinary": "bytea", "json": "jsonb", "enum": "varchar(255)", "bit": "bit", "*": "{lower}",
    },
    ("mysql", "mysql"): {
        "integer": "int", "double precision": "double", "float double": "{same_ps}", "decimal numeric": "{decimal}", "char": "{my_char}", "varchar": "{my_varchar}",
        "binary varbinary": "{same_n1}", "datetime timestamp": "datetime(6)", "year": "int", "bit": "{bit}", "enum set": "varchar(255)",
        "geometry point linestring polygon": "longtext", "*": "{lower}",
    },
    ("mysql", "dameng"): {
        "tinyint": "TINYINT", "smallint": "SMALLINT", "mediumint int integer": "INT", "bigint": "BIGINT", "decimal numeric": "{NUMBER}", "real": "BINARY_DOUBLE",
        "float double": "{DECIMAL}", "char": "{CHAR}", "varchar": "{VARCHAR2}", "tinytext": "VARCHAR2(4000)", "text mediumtext longtext": "TEXT", "json": "CLOB",
        "date": "DATE", "datetime timestamp": "TIMESTAMP", "time": "TIME", "year": "NUMBER(4)", "tinyblob blob mediumblob longblob binary varbinary": "BLOB",
        "bit": "NUMBER(1)", "enum": "VARCHAR2(255)", "set": "VARCHAR2(1024)", "*": "{upper}",
    },
    ("dameng", "mysql"): {
        "tinyint byte smallint": "smallint", "int integer mediumint": "int", "bigint": "bigint", "real": "float", "float|double|double precision": "{decimal_or_double}",
        "numeric number decimal": "{decimal_s0}", "char character": "{my_char}", "varchar varchar2": "{my_varchar}", "clob text longvarchar": "longtext",
        "binary varbinary": "{same_n1}", "blob image longvarbinary bfile": "longblob", "date": "date", "time": "time", "timestamp datetime": "datetime(6)",
        "bit boolean": "tinyint(1)", "interval year to month|interval day to second": "varchar(50)", "*": "{lower}",
    },
    ("dameng", "pg"): {
        "tinyint byte smallint": "smallint", "int integer mediumint": "int", "bigint": "bigint", "real": "real", "float|double|double precision": "{decimal}",
        "numeric number decimal": "{decimal}", "char character": "{char}", "varchar varchar2": "{varchar}", "clob text longvarchar": "text",
        "binary varbinary blob image longvarbinary bfile": "bytea", "date": "date", "time": "time", "timestamp datetime": "timestamp", "bit boolean": "smallint",
        "interval year to month|interval day to second": "interval", "*": "{lower}",
    },
    ("postgres", "dameng"): {
        "int2 smallint": "SMALLINT", "int4 integer int": "INT", "int8 bigint": "BIGINT", "numeric decimal": "{NUMBER}", "money": "NUMBER(19,4)", "float4 real": "FLOAT",
        "float8|double precision": "DOUBLE", "bool boolean": "NUMBER(1)", "bpchar char character": "{CHAR1}", "varchar|character varying": "{VARCHAR2_or_TEXT}",
        "name": "VARCHAR2(128)", "text json jsonb xml": "TEXT", "uuid": "VARCHAR2(36)", "inet cidr": "VARCHAR2(43)", "macaddr macaddr8": "VARCHAR2(23)",
        "bit varbit": "VARCHAR2(64)", "bytea": "BLOB", "date": "DATE", "time timetz": "TIME", "timestamp timestamptz datetime": "TIMESTAMP", "interval": "VARCHAR2(64)", "*": "TEXT",
    },
    ("oracle", "mysql"): {
        "number numeric decimal": "{ora_my_number}", "float|double precision|binary_double": "double", "binary_float real": "float", "integer int smallint": "int",
        "char nchar character": "{my_char}", "varchar2 nvarchar2 varchar": "{my_varchar}", "urowid rowid": "{varchar_100}", "clob nclob long": "longtext",
        "blob|raw|long raw": "longblob", "date": "datetime", "boolean": "tinyint(1)", "xmltype": "longtext", "*": "{lower}",
    },
    ("oracle", "pg"): {
        "number numeric decimal": "{ora_pg_number}", "float|binary_double|double precision": "decimal", "binary_float real": "real", "smallint integer int": "int",
        "char nchar character": "{char}", "varchar2 nvarchar2 varchar": "{varchar}", "clob nclob long xmltype": "text", "blob|raw|long raw": "bytea",
        "date timestamp": "timestamp", "timestamp with time zone|timestamp with local time zone": "timestamptz", "interval year to month|interval day to second": "interval",
        "boolean": "boolean", "*": "{lower}",
    },
    ("sqlserver", "mysql"): {
        "tinyint smallint": "smallint", "mediumint int": "int", "bigint": "bigint", "varchar nvarchar": "{max_varchar}", "char nchar": "{my_char}",
        "text ntext xml geography geometry hierarchyid": "longtext", "image": "longblob", "varbinary binary": "{max_binary}", "bit": "tinyint(1)", "uniqueidentifier": "char(36)",
        "smalldatetime datetime datetime2 datetimeoffset": "datetime(6)", "date": "date", "time": "time", "timestamp": "varbinary(8)", "numeric decimal": "{decimal}",
        "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "real": "float", "float": "double", "*": "{lower}",
    },
    ("sqlserver", "pg"): {
        "tinyint smallint mediumint int": "int", "bigint": "bigint", "varchar nvarchar": "{max_text}", "char nchar": "{char}", "text ntext xml geography geometry hierarchyid": "text",
        "varbinary binary image timestamp": "bytea", "bit": "smallint", "uniqueidentifier": "char(36)", "smalldatetime datetime datetime2": "timestamp", "date": "date",
        "time": "time", "numeric decimal": "{decimal}", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "real": "real", "float": "decimal", "*": "{lower}",
    },
}


def _names(text: str) -> list[str]:
    return text.split("|") if "|" in text else [text] if text in ("double precision", "*") else text.split(" ")


_FORMS = {pair: {n: form for names, form in rules.items() for n in _names(names)} for pair, rules in RULES.items()}


def supported(src: str, dst: str) -> bool:
    return (src, "pg" if dst in PG_FAMILY else dst) in _FORMS


def _text(kind: str, n: int, char_units: bool, nvarchar2: bool, upper: bool = False) -> str:
    up = str.upper if upper else str
    return up(f"nvarchar2({n})") if nvarchar2 else up(f"{kind}({n} char)") if char_units else up(f"{kind}({n})")


def _fill(form: str, c: Column, name: str, char_units: bool, nvarchar2: bool) -> str:
    p, s, n = c.precision, c.scale, c.length
    one = n if n > 0 else 1
    my_varchar = "text" if one > MYSQL_VARCHAR else f"varchar({one})"
    match form:
        case "{lower}":
            return name.lower()
        case "{upper}":
            return name.upper()
        case "{decimal}" | "{DECIMAL}" | "{NUMBER}":
            word = form[1:-1]
            return f"{word}({p},{s})" if p > 0 else word
        case "{decimal_s0}":
            return f"decimal({p},{max(s, 0)})" if p > 0 else "decimal"
        case "{decimal_or_double}":
            return f"decimal({p},{s})" if p > 0 else "double"
        case "{same_ps}":
            return f"{name}({p},{s})" if p > 0 else name
        case "{same_n1}":
            return f"{name}({one})"
        case "{bit}":
            return f"bit({n})" if n > 0 else "bit"
        case "{char}" | "{varchar}":
            return _text(form[1:-1], n, char_units, nvarchar2)
        case "{CHAR}" | "{VARCHAR2}":
            return _text(form[1:-1], n, char_units, nvarchar2, upper=True)
        case "{CHAR1}":
            return _text("char", one, char_units, nvarchar2, upper=True)
        case "{VARCHAR2_or_TEXT}":
            return _text("varchar2", n, char_units, nvarchar2, upper=True) if n > 0 else "TEXT"
        case "{my_char}":
            return f"varchar({one})" if one > MYSQL_CHAR else f"char({one})"
        case "{my_varchar}":
            return my_varchar
        case "{varchar_100}":
            return f"varchar({n if n > 0 else 100})"
        case "{max_varchar}":
            return "longtext" if n == -1 else my_varchar
        case "{max_text}":
            return "text" if n == -1 else _text("varchar", n, char_units, nvarchar2)
        case "{max_binary}":
            return "longblob" if n == -1 else f"{name}({one})"
        case "{ora_my_number}" | "{ora_pg_number}":
            if p > 0 and s == 0:
                return "smallint" if p <= 4 else "int" if p <= 9 else "bigint" if p <= 18 else f"decimal({p},0)"
            if form == "{ora_pg_number}":
                return f"decimal({p},{s})" if p > 0 else "decimal"
            return f"decimal({min(p, 65)},{min(max(s, 0), 30)})" if p > 0 else "double"
    return form


def map_type(src: str, dst: str, c: Column, char_units: bool = False, nvarchar2: bool = False) -> str:
    """Target type text of a column; char_units gives ``(n char)``, nvarchar2 wins over it."""
    family = "pg" if dst in PG_FAMILY else dst
    forms = _FORMS[src, family]
    # Two mappers take the name as it stands; the others without blanks around.
    name = c.data_type.lower() if (src, family) in (("mysql", "pg"), ("dameng", "pg"), ("sqlserver", "pg")) else c.data_type.strip().lower()
    whole = name
    if src == "oracle":
        name = name.split("(")[0].strip()
        if family == "mysql" and name.startswith("interval"):
            return "varchar(50)"
        if family == "mysql" and name.startswith("timestamp"):
            return "datetime(6)"
    return _fill(forms[name], c, name, char_units, nvarchar2) if name in forms else _fill(forms["*"], c, whole, char_units, nvarchar2)


def lossy(src: str, c: Column) -> str:
    """Why the target type of a column can't hold all values, or ''."""
    name = c.data_type.strip().lower()
    if src == "mysql" and name in ("float", "double") and c.precision > 0 and c.scale == 0:
        return "fraction lost"
    if src == "oracle" and re.match(r"timestamp\s*\(\d+\) with", name):
        return "time zone lost"
    if src == "mysql" and name == "bit" and c.length > 1:
        return "only one bit kept"
    return ""


_SPARK = {
    "tinyint smallint mediumint int integer int2 int4 year byte": T.IntegerType(), "bigint int8": T.LongType(), "float4 real binary_float": T.FloatType(),
    "float|double|float8|double precision|binary_double": T.DoubleType(), "date": T.DateType(), "datetime datetime2 smalldatetime timestamp": T.TimestampNTZType(),
    "timestamptz|datetimeoffset|timestamp with time zone|timestamp with local time zone": T.TimestampType(), "bool boolean": T.BooleanType(),
    "tinyblob|blob|mediumblob|longblob|binary|varbinary|bytea|raw|long raw|image|bfile|longvarbinary": T.BinaryType(),
}
_SPARK_TYPES = {n: t for names, t in _SPARK.items() for n in _names(names)}


def spark_type(src: str, c: Column, unsigned: bool = False) -> T.DataType:
    """Type that holds a source column in Spark: decimals beyond 38 digits and times of day are text."""
    name = re.sub(r"\s*\(\d+\)", "", c.data_type.strip().lower())
    if src == "oracle" and name == "date":
        return T.TimestampNTZType()
    if src == "sqlserver" and name == "timestamp":
        return T.BinaryType()
    if name == "bit":
        return T.BooleanType() if c.length <= 1 else T.BinaryType()
    if name == "bigint" and unsigned:
        return T.DecimalType(20, 0)
    if name in ("decimal", "numeric", "number", "money", "smallmoney"):
        p, s = {"money": (19, 4), "smallmoney": (10, 4)}.get(name, (c.precision, max(c.scale, 0)))
        return T.StringType() if p > 38 else T.DecimalType(p, s) if p > 0 else T.DoubleType() if name == "number" else T.DecimalType(38, 10)
    return _SPARK_TYPES.get(name, T.StringType())
