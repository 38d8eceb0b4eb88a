"""Pure functions: type maps, defaults, DDL, positions, console, views, globs."""

import pytest

from tablebridge.functions import console, views
from tablebridge.functions.ddl import DIALECTS, ForeignKey, Index, Table, distribute
from tablebridge.functions.defaults import clean_default
from tablebridge.functions.positions import Position, available, equivalent, gtid_contains, gtid_merge, reached, server_id
from tablebridge.functions.typemap import Column, lossy, map_type, spark_type, supported
from tablebridge.operators.jobs import may_move, retention_seconds
from tablebridge.sources import readers, sinks
from tablebridge.sources.catalog import matches

A = "3e11fa47-71ca-11e1-9e33-c80aa9429562"


def c(t, n=0, p=0, s=0):
    return Column("c", t, n, p, s)


@pytest.mark.parametrize(("src", "dst", "col", "opt", "want"), [
    ("mysql", "postgres", c("TINYINT"), {}, "int"), ("mysql", "postgres", c("double", p=22), {}, "decimal(22,0)"), ("mysql", "postgres", c("float"), {}, "decimal"),
    ("mysql", "postgres", c("char", 3), {"char_units": True}, "char(3 char)"), ("mysql", "postgres", c("varchar", 3), {"nvarchar2": True, "char_units": True}, "nvarchar2(3)"),
    ("mysql", "seabox", c("json"), {}, "jsonb"), ("mysql", "postgres", c("weird"), {}, "weird"), ("mysql", "postgres", c("year"), {}, "int"),
    ("mysql", "mysql", c("char", 300), {}, "varchar(300)"), ("mysql", "mysql", c("bit", 8), {}, "bit(8)"), ("mysql", "mysql", c("double", p=10, s=2), {}, "double(10,2)"), ("mysql", "mysql", c("point"), {}, "longtext"),
    ("mysql", "dameng", c("varchar", 5), {}, "VARCHAR2(5)"), ("mysql", "dameng", c("varchar", 5), {"char_units": True}, "VARCHAR2(5 CHAR)"), ("mysql", "dameng", c("decimal", p=9, s=2), {}, "NUMBER(9,2)"), ("mysql", "dameng", c("year"), {}, "NUMBER(4)"),
    ("dameng", "mysql", c("double precision"), {}, "double"), ("dameng", "mysql", c("number", p=5, s=-2), {}, "decimal(5,0)"), ("dameng", "postgres", c("interval year to month"), {}, "interval"),
    ("postgres", "dameng", c("varchar"), {}, "TEXT"), ("postgres", "dameng", c("bpchar"), {}, "CHAR(1)"), ("postgres", "dameng", c("character varying", 9), {}, "VARCHAR2(9)"), ("postgres", "dameng", c("_text"), {}, "TEXT"),
    ("oracle", "mysql", c("NUMBER"), {}, "double"), ("oracle", "mysql", c("NUMBER", p=4), {}, "smallint"), ("oracle", "mysql", c("NUMBER", p=38), {}, "decimal(38,0)"), ("oracle", "mysql", c("NUMBER", p=70, s=40), {}, "decimal(65,30)"),
    ("oracle", "mysql", c("TIMESTAMP(6) WITH TIME ZONE"), {}, "datetime(6)"), ("oracle", "mysql", c("INTERVAL YEAR(2) TO MONTH"), {}, "varchar(50)"), ("oracle", "mysql", c("ROWID"), {}, "varchar(100)"), ("oracle", "mysql", c("VARCHAR2", 20000), {}, "text"),
    ("oracle", "postgres", c("TIMESTAMP(6) WITH TIME ZONE"), {}, "timestamp"), ("oracle", "postgres", c("TIMESTAMP WITH TIME ZONE"), {}, "timestamptz"), ("oracle", "postgres", c("NUMBER", p=18), {}, "bigint"), ("oracle", "postgres", c("NUMBER"), {}, "decimal"),
    ("sqlserver", "mysql", c("varbinary", -1), {}, "longblob"), ("sqlserver", "mysql", c("timestamp"), {}, "varbinary(8)"), ("sqlserver", "postgres", c("varchar", -1), {}, "text"), ("sqlserver", "postgres", c("smallmoney"), {}, "decimal(10,4)"),
])
def test_type_map(src, dst, col, opt, want):
    assert map_type(src, dst, col, **opt) == want


def test_type_support():
    assert supported("mysql", "kingbase") and not supported("postgres", "mysql")
    assert lossy("mysql", c("double", p=22)) and lossy("oracle", c("TIMESTAMP(6) WITH TIME ZONE")) and not lossy("mysql", c("int"))
    assert spark_type("mysql", c("decimal", p=65, s=2)).simpleString() == "string"
    assert spark_type("oracle", c("DATE")).simpleString() == "timestamp_ntz"
    assert spark_type("mysql", c("bigint"), unsigned=True).simpleString() == "decimal(20,0)"
    assert spark_type("mysql", c("time")).simpleString() == "string"


@pytest.mark.parametrize(("src", "raw", "want"), [
    ("oracle", "''0''", "0"), ("oracle", "'''abc'''", "'abc'"), ("oracle", "'0'", "0"), ("dameng", "NULL", "NULL"), ("postgres", "'it''s'::text", "it's"), ("postgres", "'1'::numeric::int", "1"), ("postgres", "now()", "now()"),
    ("sqlserver", "((0))", "0"), ("sqlserver", "(getdate())", "getdate()"), ("sqlserver", "(N'abc')", "'abc'"), ("sqlserver", "(a)+(b)", "(a)+(b)"), ("mysql", "(' ')", " "), ("mysql", "(0)", "0"), ("db2", " x ", " x "),
])
def test_defaults(src, raw, want):
    assert clean_default(src, raw) == want


def test_ddl():
    t = Table("Users", [Column("id", "bigint", nullable=False, extra="auto_increment"), Column("name", "varchar", 100), Column("age", "int", default="0"), Column("flag", "bit", 1, default="b'1'"), Column("made", "datetime", default="CURRENT_TIMESTAMP")])
    pg = DIALECTS["postgres"].create_table("app", t, "mysql", str.lower)[0]
    assert pg.startswith('DROP TABLE IF EXISTS "app"."users" CASCADE;\nCREATE TABLE "app"."users" (\n  "id" bigint NOT NULL,\n') and "DEFAULT B'1'" in pg and "DEFAULT '0'" in pg
    my = DIALECTS["mysql"].create_table("", t, "mysql")[1]
    assert "`id` bigint NOT NULL AUTO_INCREMENT" in my and "`age` int DEFAULT 0" in my and "`flag` bit(1) DEFAULT 1" in my and "datetime(6) DEFAULT CURRENT_TIMESTAMP" in my
    dm = DIALECTS["dameng"].create_table("app", t, "mysql")
    assert dm[0] == 'DROP TABLE "APP"."USERS" CASCADE CONSTRAINTS' and '"ID" BIGINT IDENTITY(1, 1) NOT NULL' in dm[1]
    assert "USING parquet" in DIALECTS["spark"].create_table("", t, "mysql")[1]
    i = Index("t", "i1", ["a", "b"], unique=True)
    assert DIALECTS["postgres"].index("s", i) == 'CREATE UNIQUE INDEX IF NOT EXISTS "i1" ON "s"."t" ("a", "b");'
    assert DIALECTS["mysql"].index("", i) == "ALTER TABLE `t` ADD UNIQUE INDEX `i1` (`a`, `b`)"
    assert DIALECTS["dameng"].index("s", i) == 'CREATE UNIQUE INDEX "T_I1" ON "S"."T" ("A", "B")'
    k = ForeignKey("c", "fk", ["x"], "p", ["id"], "CASCADE", "NO ACTION")
    assert DIALECTS["mysql"].foreign_key("", k).endswith("REFERENCES `p` (`id`) ON DELETE CASCADE")
    assert DIALECTS["postgres"].foreign_key("", k).endswith("ON DELETE CASCADE ON UPDATE NO ACTION;")
    assert DIALECTS["gaussdb"].adjust_view("select gen_random_uuid()") == "select uuid()"
    assert distribute("gaussdb", "s", "t", ["id"]) == 'ALTER TABLE "s"."t" DISTRIBUTE BY HASH("id")' and distribute("postgres", "s", "t", ["id"]) == ""
    assert DIALECTS["mysql"].comment("", "t", "c", "x") == [] and DIALECTS["mysql"].sequence("", "t", "id", 0)[0].endswith("= 1")


def test_positions():
    assert reached(Position("binlog.000010", 100), Position("binlog.000010", 100)) and not reached(Position("binlog.000009", 500), Position("binlog.000010", 4))
    assert reached(Position("binlog.000100", 4), Position("binlog.000099", 900)) and reached(Position("a", 1), Position())
    assert gtid_contains(f"{A}:1-10", f"{A.upper()}:3-5:7") and not gtid_contains(f"{A}:1-4", f"{A}:5")
    assert gtid_merge(f"{A}:1-5", f"{A}:6-7") == f"{A}:1-7" and gtid_merge("", f"{A}:1") == f"{A}:1" and gtid_merge("bad", f"{A}:1") == "bad"
    assert reached(Position(gtid=f"{A}:1-9"), Position(gtid=f"{A}:9")) and equivalent(Position(gtid=f"{A}:1-3"), Position(gtid=f"{A}:1:2-3"))
    assert equivalent(Position("f", 1), Position("f", 1)) and not equivalent(Position("f", 1), Position("f", 2)) and not equivalent(Position(), Position())
    assert available(Position("f", 5), logs={"f": 9}) == "" and available(Position("f", 10), logs={"f": 9}) and available(Position(gtid=f"{A}:1-3"), executed=f"{A}:1-9", purged=f"{A}:1-5")


@pytest.mark.parametrize(("sql", "level", "rows"), [
    ("SELECT 1;", "readonly", True), ("/* c */ show tables", "readonly", True), ("with x as (select 1) select * from x", "readonly", True), ("with d as (delete from t returning *) select * from d", "write", True),
    ("update t set a = 'x;y'", "write", False), ("insert into t values (1) returning id", "write", True), ("create table t (a int)", "dangerous", False), ("select 1 into outfile 'x'", "dangerous", True),
    ("select $$a;b$$", "readonly", True), ("select 'it''s \\' ok' # note", "readonly", True), ("explain analyze delete from t", "readonly", True),
])
def test_console(sql, level, rows):
    r = console.analyse(sql)
    assert (r.level, r.returns_rows) == (level, rows)


@pytest.mark.parametrize("sql", ["", "select 1; select 2", "begin", "select 'x", "select (1", "/* x", "delimiter //", "-- only", "select $a$ x", "select 1" + " " * 3 + "x" * (1 << 20)])
def test_console_rejects(sql):
    with pytest.raises(ValueError):
        console.analyse(sql)


def test_console_policy():
    danger = console.analyse("drop table t")
    assert console.confirmation(danger, "生产") == "name" and console.confirmation(danger, "test") == "click" and console.confirmation(console.analyse("select 1"), "prod") == "none"
    assert console.cut_bytes("é" * 3000) == "é" * 2000 and console.compact("a \n b") == "a b" and len(console.compact("x" * 300)) == 241


def test_views():
    assert views.from_mysql("select if(a > 1, 'x, y', if(b, 1, 2)) from t", to="postgres") == "select CASE WHEN a > 1 THEN 'x, y' ELSE CASE WHEN b THEN 1 ELSE 2 END END from t"
    assert views.from_mysql("select group_concat(x separator '|') from t") == "select string_agg(x, '|') from t"
    assert "CROSS join" in views.from_mysql("select 1 from a join b where x = 1") and "CROSS" not in views.from_mysql("select 1 from a join b on x = y left join c using (z)")
    assert views.from_sqlserver("create view v as select top 100 percent a + '-' + b as 'c d', n + m as k from t order by a", to="postgres") == 'select a || \'-\' || b AS "c d", n + m as k from t'
    assert views.from_oracle('select "A"."X", nvl(b, 1) from dual', to="postgres") == 'select A."X", coalesce(b, 1)'
    assert views.strip_order("select a, row_number() over (order by a) as r from (select top 5 a from t order by a) x\nORDER   BY a desc") == "select a, row_number() over (order by a) as r from (select top 5 a from t order by a) x"
    assert views.strip_order("select [order by], 'order by x' as s from t -- order by a") == "select [order by], 'order by x' as s from t -- order by a"
    assert views.strip_schemas("select * from DB1.t join db1.u", ["db1"]) == "select * from t join u"


def test_small_rules():
    assert matches("order_log", ["*_log"]) and not matches("a/b", ["*"]) and not matches("x", ["[a"]) and matches("a1", ["a[0-9]"])
    assert retention_seconds("OFF", "5", "5") == 0 and retention_seconds(None, "3600", "1") == 3600 and retention_seconds(None, "0", "2") == 172800 and retention_seconds(None, "x", None) is None
    assert retention_seconds(None, None, str(2**62)) is None and retention_seconds(None, "0", "0") == 0
    assert may_move("running", "paused_ddl") and not may_move("stopped", "running")
    con = readers.Connection("mysql", "h", 3306, "d", "u", "p")
    assert readers.dsn(con) == "u:p@tcp(h:3306)/d?parseTime=true&charset=utf8mb4" and readers.jdbc_options(con, "t", "id", (1, 9))["numPartitions"] == "10"
    assert all(readers.dsn(readers.Connection(k, "h", 1)) and readers.jdbc_url(readers.Connection(k, "h", 1)) for k in readers.SOURCES)
    assert readers.pair_supported("highgo", "dameng") and readers.pages(20001) == 2


def test_sums_and_concatenations():
    got = views.concatenated("a + 1, isnull(b, '') + '-' + c, (d + e) * 2, 'p + q' + f, len(g) + len(h), cast(i as varchar) + j where k + 1 > 2 and l + 'x' = m")
    assert got == "a + 1, isnull(b, '') || '-' || c, (d + e) * 2, 'p + q' || f, len(g) + len(h), cast(i as varchar) || j where k + 1 > 2 and l || 'x' = m"


def test_mysql_strings_and_nested_joins():
    assert views.plain_strings("""select "it's" as `a"b`, 'q"r' where x = "a""b" """) == """select 'it''s' as `a"b`, 'q"r' where x = 'a"b' """
    assert views.flat_from("select * from ((a join b on((a.x = b.x))) join (c join d on(c.i = d.i)) on((a.y = c.y))) where (a.x > 1)") == "select * from a join b on((a.x = b.x)) join (c join d on(c.i = d.i)) on((a.y = c.y)) where (a.x > 1)"
    assert views.flat_from("select '(from (x' from (select 1) t") == "select '(from (x' from (select 1) t"


def test_statements_of_sinks():
    assert sinks.promote("dameng", "app", "t", "t__stage", ["id", 'a"b'], identity=True) == ['SET IDENTITY_INSERT "app"."t" ON', 'INSERT INTO "app"."t" ("id", "a""b") SELECT "id", "a""b" FROM "app"."t__stage"', 'SET IDENTITY_INSERT "app"."t" OFF'] and sinks.drop_stage("dameng", "app", "t__stage") == 'DROP TABLE "app"."t__stage"'
    assert sinks.promote("mysql", "app", "t", "s", ["id"], identity=True) == ["INSERT INTO `app`.`t` (`id`) SELECT `id` FROM `app`.`s`"] and sinks.drop_stage("mysql", "app", "s") == "DROP TABLE `app`.`s`"
    assert sinks.create_view("gaussdb", "app", "v", "select 1;") == ['SET LOCAL search_path TO "app"', 'CREATE OR REPLACE VIEW "app"."v" AS select 1'] and len(sinks.create_view("mysql", "app", "v", "select 1")) == 1
    assert sinks.change_owner("postgres", "app", "t", "joe") == ['ALTER TABLE "app"."t" OWNER TO "joe"'] and sinks.change_owner("mysql", "app", "t", "joe") == []
    with pytest.raises(ValueError):
        sinks.sink_for(None, "oracle")


def test_server_id():
    # FNV-1a of "a" is 0xe40c292c
    assert server_id("") == 1000 + 0x811C9DC5 and server_id("a") == 1000 + 0xE40C292C
