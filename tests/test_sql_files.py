import io
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlstone.cli import main
from marlstone.engine import Engine
from marlstone.errors import PlanFault
from marlstone.sources import readers
from marlstone.sources.readers import read_parquet
from marlstone.streaming.stdin import Spool

from . import tables


@pytest.fixture
def folder(tmp_path):
    return tables.write(tmp_path)


@pytest.fixture
def engine(spark, folder):
    e = Engine(spark, folder, overwrite=True)
    yield e
    e.close()


def read(folder, name):
    with open(os.path.join(folder, name), encoding="utf-8", newline="") as f:
        return f.read()


def test_into_keeps_the_layout_of_the_left_table(engine, folder):
    engine.execute("select a.foo, b.bar x, 5 into [out.txt] from t1 a join t2 b on a.foo = b.foo order by x")
    assert read(folder, "out.txt") == "foo\tx\t\nB2c3d4e5\tx1\t5\nd4e5f6a7\tx3\t5\nd4e5f6a7\tx4\t5\n"
    assert not [n for n in os.listdir(folder) if n.startswith(".")]


def test_into_without_overwrite_fails_and_leaves_the_file(spark, folder):
    before = read(folder, "t2.csv")
    with pytest.raises(PlanFault):
        Engine(spark, folder).execute("select foo into [t2.csv] from t1")
    assert read(folder, "t2.csv") == before


def test_a_failure_leaves_the_file(engine, folder):
    before = read(folder, "t1.tsv")
    with pytest.raises(Exception):  # noqa: B017
        engine.execute("update t1 set baz = bar + 1")
    assert read(folder, "t1.tsv") == before


def test_floats_and_quotes(engine, folder):
    engine.execute("select 1.5 f, name into [q.csv] from grades where id < 3")
    assert read(folder, "q.csv") == 'f,name\n1.500000,Joe\n1.500000,"Ann, ""A"""\n'
    assert [tuple(r) for r in engine.query("select f, name into [p.csv] from [q.csv] select * from [p.csv]").collect()] == [("1.500000", "Joe"), ("1.500000", 'Ann, "A"')]


def test_script_keeps_kinds(engine):
    assert engine.query("select baz + 0 n into [k.csv] from t1 where baz = 300 select n + n from [k.csv]").first()[0] == 600


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("delete t1", ""),
        ("delete t1 from t1 where 1 = 1", ""),
        ("delete d from t1 d", ""),
        ("delete [t1.tsv] where bar = 'CB'", "a1b2c3d4\t70\t300\nc3d4e5f6\t5F\t200\nd4e5f6a7\tf8\t900\ne5f6a7b8\t6c\t700\n"),
        ("delete from t1 where baz < 700", "d4e5f6a7\tf8\t900\ne5f6a7b8\t6c\t700\n"),
        ("delete d from t1 d join t2 on d.foo = t2.foo", "a1b2c3d4\t70\t300\nc3d4e5f6\t5F\t200\ne5f6a7b8\t6c\t700\n"),
        ("update t1 set bar = 'x' where baz > 600", "a1b2c3d4\t70\t300\nB2c3d4e5\tcb\t400\nc3d4e5f6\t5F\t200\nd4e5f6a7\tx\t900\ne5f6a7b8\tx\t700\n"),
        ("update u set bar = foo, baz -= 1 from t1 u where bar = '70'", "a1b2c3d4\ta1b2c3d4\t299\nB2c3d4e5\tcb\t400\nc3d4e5f6\t5F\t200\nd4e5f6a7\tf8\t900\ne5f6a7b8\t6c\t700\n"),
        ("update u set bar = t2.bar from t1 u join t2 on u.foo = t2.foo", "a1b2c3d4\t70\t300\nB2c3d4e5\tx1\t400\nc3d4e5f6\t5F\t200\nd4e5f6a7\tx3\t900\ne5f6a7b8\t6c\t700\n"),
    ],
)
def test_rewriting(engine, folder, sql, expected):
    events = engine.execute(sql)
    assert read(folder, "t1.tsv") == "foo\tbar\tbaz\n" + expected
    assert events[-1].rows == expected.count("\n")


def test_fixed_width_round_trip(engine, folder):
    engine.execute("select name, num, eor into [f2.txt] from wide.fixed where num > 2000")
    assert read(folder, "f2.txt") == "beta  5678\n"
    with pytest.raises(Exception, match="(?s)Truncation"):
        engine.execute("select name + 'much too long', num, eor into [f3.txt] from wide.fixed")
    assert not os.path.exists(os.path.join(folder, "f3.txt"))


def test_temporary_tables_go(engine, spark, folder):
    assert engine.query("select distinct bar into #b from t3 select count(*) from #b").first()[0] == 3
    work = engine.work
    assert os.path.isdir(work)
    engine.reset()
    assert not os.path.exists(work)
    with pytest.raises(PlanFault):
        engine.prepare("select * from #b")


def test_split_by_value(engine, folder):
    engine.execute(
        "select distinct bar into #list from t3 declare @b varchar = (select top 1 bar from #list order by bar) declare @f varchar = 'part_' + @b + '.txt' "
        "while @b is not null begin select foo, bar into @f from t3 where bar = @b order by foo desc set @b = (select top 1 bar from #list where bar > @b order by bar) set @f = 'part_' + @b + '.txt' end"
    )
    assert {n: read(folder, n) for n in os.listdir(folder) if n.startswith("part_")} == {"part_ae.txt": "foo|bar\nk6|AE\nk1|ae\n", "part_cd.txt": "foo|bar\nk4|cd\nk3|CD \nk2|cd\n", "part_e0.txt": "foo|bar\nk5|e0\n"}


def test_ambiguous_and_extensionless_names(engine, folder):
    with open(os.path.join(folder, "t1.bak"), "w") as f:
        f.write("foo\n")
    with pytest.raises(PlanFault, match="ambiguous"):
        engine.prepare("select foo from T1")
    os.makedirs(os.path.join(folder, "sub"))
    with open(os.path.join(folder, "sub", "deep.csv"), "w") as f:
        f.write("a\n7\n")
    assert engine.query("select a from [sub/deep]").first()[0] == "7"


def test_quoting_standards(spark, tmp_path):
    with open(tmp_path / "q.csv", "w") as f:
        f.write('a,b\n"x",1\n')
    assert Engine(spark, str(tmp_path), in_std="none").query("select a from q").first()[0] == '"x"'
    assert Engine(spark, str(tmp_path)).query("select a from q").first()[0] == "x"
    Engine(spark, str(tmp_path), out_std="all", overwrite=True, crlf_output=True, out_delim=";").execute("select a, b into [w.csv] from q")
    assert read(str(tmp_path), "w.csv") == 'a;b\r\n"x";"1"\r\n' or read(str(tmp_path), "w.csv") == '"a";"b"\r\n"x";"1"\r\n'


def run_cli(spark, folder, *args, stdin=b""):
    out, here = io.StringIO(), os.getcwd()
    os.chdir(folder)
    try:
        return main(list(args), spark, out, io.BytesIO(stdin)), out.getvalue()
    finally:
        os.chdir(here)


def test_command_line(spark, folder, capsys):
    assert run_cli(spark, folder, "-c", "select foo, baz + 0.5 from t1 where baz = 300") == (0, "foo\t\na1b2c3d4\t300.500000\n")
    assert run_cli(spark, folder, "-h", "-S", ";", "-W", "-c", "select foo, bar from t1 where baz = 300") == (0, "a1b2c3d4;70\r\n")
    assert run_cli(spark, folder, stdin=b"select 'hello'") == (0, "\nhello\n")
    assert run_cli(spark, folder, "-c", "select b from __stdin where a > 1", stdin=b"a,b\n1,x\n2,y\n") == (0, "b\ny\n")
    assert run_cli(spark, folder, "-D", "n=300", "-c", "declare @n int select foo from t1 where baz = @n") == (0, "foo\na1b2c3d4\n")
    assert run_cli(spark, folder, "--schema=noheader", "-H", "-c", "select __2 from bare where __1 = 2") == (0, "__2\nJane\n")
    assert run_cli(spark, folder, "-s", "|", "-c", "select bar from t3 where foo = 'k1'") == (0, "bar\nae\n")
    assert run_cli(spark, folder, "-d", "-c", "select foo into [x.txt] from t1") == (0, "")
    assert run_cli(spark, folder, "-c", "select nope from t1")[0] == 1
    assert "nope" in capsys.readouterr().err
    with open(os.path.join(folder, "s.sql"), "w") as f:
        f.write("select foo into [made.txt] from t1 where baz = 300")
    assert run_cli(spark, folder, "-o", "s.sql") == (0, "")
    assert read(folder, "made.txt") == "foo\na1b2c3d4\n" and "(1 rows affected)" in capsys.readouterr().err


def test_stdin_once(spark, folder):
    e = Engine(spark, folder, io.BytesIO(b"a\n1\n"), allow_stdin=True)
    with pytest.raises(PlanFault):
        e.prepare("select * from __stdin x join __stdin y on x.a = y.a")
    assert e.query("select a from __stdin").first()[0] == "1"


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_stdin_in_a_shared_folder(spark, tmp_path, scheme):
    """The spooled input lies in the shared folder while it is used: a path, a local URI, and any other URI."""
    spool = Spool(io.BytesIO(b"a\n1\n"), f"{scheme}{tmp_path}/shared", spark)
    path = spool.file()
    assert [r[0] for r in spark.read.text(path).collect()] == ["a", "1"] and spool.file() == path
    assert [p.name for p in (tmp_path / "shared").glob("stdin-*")] == [os.path.basename(path)]
    spool.close()
    assert not list((tmp_path / "shared").glob("stdin-*"))


def test_micro_batches(spark, tmp_path):
    from marlstone.streaming.microbatch import select_each_batch

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    got = []
    q = select_each_batch(Engine(spark, str(tmp_path)), "select v, sum(k) s from events group by v order by v", stream, "events", lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == [("a", 4), ("b", 2)]


def test_invalid_utf8(spark, tmp_path):
    with open(tmp_path / "bad.csv", "wb") as f:
        f.write(b"a,b\nok,1\n\xff\xfex,2\n")
    e = Engine(spark, str(tmp_path))
    assert e.query("select count(*) from bad").first()[0] == 2 and e.query("select left(a, 1) from bad where b = 1").first()[0] == "o"
    for f in ("left(a, 1)", "right(a, 1)", "substring(a, 1, 1)", "len(a)"):
        with pytest.raises(Exception, match="invalid UTF-8"):
            e.query(f"select {f} from bad").collect()
    assert Engine(spark, str(tmp_path), char_as_byte=True).query("select len(a) from bad where b = 2").first()[0] > 1


@pytest.mark.parametrize("files", [3, 300])
def test_rows_of_many_parquet_files_have_their_own_places(spark, tmp_path, files):
    os.makedirs(tmp_path / "many.parquet")
    for i in range(files):
        pq.write_table(pa.table({"k": [2 * i, 2 * i + 1]}), tmp_path / "many.parquet" / f"part {i:05d}.parquet")
    table = read_parquet(spark, str(tmp_path / "many.parquet"))
    places = {r["c0"]: r["p"] for r in table.df.select("c0", table.place.alias("p")).collect()}
    assert len(set(places.values())) == 2 * files and sorted(places, key=places.get) == list(range(2 * files))
    pq.write_table(pa.table({"k": [0, 5]}), tmp_path / "gone.parquet")
    with_engine = Engine(spark, str(tmp_path), overwrite=True)
    with_engine.execute("delete m from [many.parquet] m join [gone.parquet] g on m.k = g.k")
    left = [r[0] for r in with_engine.query("select k from [many.parquet]").collect()]
    with_engine.close()
    assert sorted(left) == [k for k in range(2 * files) if k not in (0, 5)]


@pytest.mark.parametrize("text", ['a,b\n1,"x\ny"\n2,z\n', 'a,b\n1,"x ""q"", y"\n"2",z\n', 'a,b\n1,p"q\n2,"z\n"\n', 'a,b\r\n1,x\r\n2,"y\r\nz"\r\n', "a,b\n1,x\n2,y\n"])
def test_line_breaks_in_quotes_do_not_depend_on_size_or_path(spark, tmp_path, monkeypatch, text):
    (tmp_path / "t.csv").write_bytes(text.encode())
    path = str(tmp_path / "t.csv")
    rows = lambda p: [tuple(r) for r in readers.read(spark, p, None, readers.Options()).df.collect()]
    small = rows(path)
    assert rows("file://" + path) == small
    monkeypatch.setattr(readers, "MULTILINE_BYTES", 4)
    assert rows(path) == small and len(small) == 2
    assert readers._breaks_records(spark, path, ",", "RFC4180") == ('"x\n' in text or '"z\n' in text or '"y\r' in text)
