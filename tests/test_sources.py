"""Readers on files with the defects they exist for."""

import json
import zipfile

import pytest
from helpers import norm, rows

import millrace as mr
from millrace.sources import (archives as archives_module, delimited as delimited_module,
                              folders as folders_module, structured as structured_module)
from millrace.sources.delimited import detect
from millrace.sources.files import list_folder, listing
from millrace.sources.html import parse_tables
from millrace.sources.ranges import Lines, Quotes, records


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_and_types(spark, tmp_path, sep):
    lines = [("id", "code", "amount", "ok", "when", "empty"),
             ("1", "007", "1.5", "True", "2024-01-02", ""),
             ("2", "012", "NA", "false", "2024-01-03", "NULL")]
    p = put(tmp_path / "a file.txt", "﻿" + "".join(sep.join(x) + "\n" for x in lines))
    df = mr.read_any(spark, p)
    assert dict(df.dtypes) == {"id": "bigint", "code": "bigint", "amount": "double",
                               "ok": "boolean", "when": "string", "empty": "string"}
    assert rows(df, "id", "code", "amount", "when", "empty") == norm(
        [(1, 7, 1.5, "2024-01-02", None), (2, 12, None, "2024-01-03", None)])
    text = mr.read_delimited(spark, p, infer=False).result
    assert rows(text, "code") == [("007",), ("012",)]
    given = mr.read_delimited(spark, p, sep=sep, encoding="utf-8", multi_line=False,
                              types={"id": "int"}, columns=["id", "code"]).result
    assert given.dtypes == [("id", "int"), ("code", "string")]


@pytest.mark.parametrize("raw,encoding,want", [
    ("é€–".encode(), "utf-8", "é€–"), ("€ é".encode("cp1252"), "cp1252", "€ é"),
    (b"\xe9\x81", "latin-1", "é\x81")])
def test_encodings(spark, tmp_path, raw, encoding, want):
    # The telling byte stands at the very end, far beyond the sniffed head.
    p = put(tmp_path / "e.csv", b"id,t\n" + b"1,plain text\n" * 3000 + b"2," + raw + b"\n")
    assert detect(spark, p).first()["encoding"] == encoding
    assert mr.read_any(spark, p).filter("id = 2").first()["t"] == want


def test_bad_lines_and_quotes(spark, tmp_path):
    p = put(tmp_path / "b.csv", 'a,b,a\n1,"x\ny",2\n3,z\n4,5,6,7\n8,"say ""hi""",9\n')
    out = mr.read_delimited(spark, p)
    assert out.result.columns == ["a", "b", "a.1"]
    assert rows(out.result) == norm([(1, "x\ny", 2), (3, "z", None), (8, 'say "hi"', 9)])
    assert out.bad_lines.count() == 1


def test_json_array_and_object(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps([{"n": {"b": 1, "c": {"d": "x"}}, "l": [1, 2]},
                                             {"n": {"b": 2}}], indent=1))
    df = mr.read_any(spark, a)
    assert sorted(df.columns) == ["l", "n.b", "n.c.d"]
    assert rows(df, "n.b", "n.c.d") == norm([(1, "x"), (2, None)])
    assert mr.read_any(spark, put(tmp_path / "o.json", '{"a": 1}')).count() == 1


def test_xml(spark, tmp_path):
    p = put(tmp_path / "x.xml", "<all><r i='1'><a>1</a><g><b>x</b><b>y</b></g></r>"
                                "<r><a> </a><c>z</c></r></all>")
    df = mr.read_any(spark, p)
    assert rows(df, "a", "b", "c") == norm([("1", "y", None), (None, None, "z")])


def test_html(spark, tmp_path):
    p = put(tmp_path / "p.html", "<p>x<table><tr><th>id<th>t</tr><tr><td>1<td>a <b>b</b>&amp;c"
                                 "<tr><td>2</table><table><tr><td>other</table>")
    df = mr.read_any(spark, p)
    assert df.columns == ["id", "t"] and rows(df) == norm([(1, "a b&c"), (2, None)])
    tables = parse_tables("<table><tr><td colspan=2>a<td><table><tr><td>in</table></table>")
    assert tables == [[["a", "a", ""]], [["in"]]]


@pytest.fixture
def archives(tmp_path):
    for i in (1, 2):
        with zipfile.ZipFile(tmp_path / f"z{i}.zip", "w") as z:
            z.writestr("notes.sql", "select 1")
            z.writestr("dir/A.csv", f'id;t\n{i};"x\ny"\n\n{i + 10};"q;"\n9\n1;2;3\n')
            z.writestr("b.json", json.dumps([{"k": i}]))
            z.writestr("c.xml", f"<rs><r><v>{i}</v></r></rs>")
    return str(tmp_path)


def test_archives(spark, archives):
    assert rows(mr.members(spark, archives, skip_extensions=[".sql"]), "archive", "name") == norm(
        (f"z{i}.zip", n) for i in (1, 2) for n in ("A.csv", "b.json", "c.xml"))
    df = mr.read_archive(spark, archives, "a.CSV", source_column="src")
    assert rows(df, "id", "t", "src") == norm(
        [r for i in (1, 2) for r in ((i, "x\ny", f"z{i}.zip"), (i + 10, "q;", f"z{i}.zip"),
                                     (9, None, f"z{i}.zip"))])
    one = f"{archives}/z1.zip"
    assert rows(mr.read_any(spark, one), "id") == norm([(1,), (11,), (9,)])
    assert rows(mr.read_archive(spark, [one, one], "b.json")) == norm([(1,)])
    assert rows(mr.read_archive(spark, archives, "c.xml", source_column="src")) == norm(
        [("1", "z1.zip"), ("2", "z2.zip")])
    with pytest.raises(ValueError, match="not found"):
        mr.read_archive(spark, archives, "gone.csv")
    assert {n: t.count() for n, t in mr.archive_tables(spark, archives).items()} == {
        "A.csv": 6, "b.json": 2, "c.xml": 2}


def test_folders(spark, tmp_path, archives):
    folder = tmp_path / "in"
    put(folder / "a.csv", "﻿A,B\n1,2\n")
    put(folder / "b.csv", "﻿X;Y\n3;4\n")
    put(folder / "c.tsv", "A\tB\tC\n5\t6\t7\n")
    put(folder / "d.json", '[{"A": 8}]')
    put(folder / "e.xml", "<all><r><A>9</A></r></all>")
    put(folder / "f.xml", "<all><q><A>10</A></q></all>")
    put(folder / "g.json", '{"A": 11, "B": 12}')
    out = mr.union_folder(spark, str(folder), source_tag="src")
    assert rows(out, "A", "B", "X", "Y", "C", "src") == norm([
        (1, 2, None, None, None, "a.csv"), (None, None, 3, 4, None, "b.csv"),
        (5, 6, None, None, 7, "c.tsv"), (8, None, None, None, None, "d.json"),
        (9, None, None, None, None, "e.xml"), (10, None, None, None, None, "f.xml"),
        (11, 12, None, None, None, "g.json")])
    fitted = mr.union_folder(spark, str(folder), ["a.csv", "b.csv"], output_columns="a,b")
    assert rows(fitted, "a", "b") == norm([(1, 2), (3, 4)])
    with pytest.raises(FileNotFoundError):
        mr.union_folder(spark, str(folder), ["gone.csv"])
    with pytest.raises(ValueError, match="formats"):
        mr.read_any(spark, str(folder))
    seen = mr.folder_inventory(spark, str(folder))
    assert rows(seen, "file", "rows") == norm([
        (f, 1) for f in ("a.csv", "b.csv", "c.tsv", "d.json", "e.xml", "f.xml", "g.json")])
    inside = mr.folder_inventory(spark, archives)
    assert rows(inside, "file", "rows") == norm([
        (f"z{i}.zip/{n}", k) for i in (1, 2) for n, k in (
            ("dir/A.csv", 4), ("b.json", 1), ("c.xml", 1), ("notes.sql", 0))])


def test_sinks(spark, tmp_path):
    df = spark.range(3).selectExpr("id", "concat('a\"', id) as t")
    done = mr.write_outputs({"result": df, "report": df.limit(1)}, str(tmp_path), "csv",
                            quote_all=True)
    assert [(d["rows"], d["columns"]) for d in done] == [(3, 2), (1, 2)]
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("*.csv"))
    assert text == '"id","t"\n"0","a""0"\n'
    assert rows(mr.read_any(spark, str(tmp_path / "result"))) == norm(
        [(0, 'a"0'), (1, 'a"1'), (2, 'a"2')])
    mr.write(df, str(tmp_path / "j"), "json")
    assert mr.read_any(spark, str(tmp_path / "j")).count() == 3


@pytest.mark.parametrize("size", [1, 7, 64, None])
def test_quoted_breaks_by_ranges(spark, tmp_path, size):
    text = 'a,b\n1,"x\ny ""q"","\n2,5" z\n3,"é\n\n,"\n4,"end"'
    p = put(tmp_path / "q.csv", "﻿" + text)
    out = mr.read_delimited(spark, p, range_bytes=size).result
    assert rows(out) == norm([(1, 'x\ny "q",'), (2, '5" z'), (3, "é\n\n,"), (4, "end")])
    tasks = out.rdd.getNumPartitions()
    assert size != 1 or tasks > 1


@pytest.mark.parametrize("size", [1, 9, None])
def test_json_documents_by_ranges(spark, tmp_path, size):
    made = [{"a": 1, "t": '}{"\\'}, {"a": 2, "n": {"x": [1, {"y": []}]}}, {"a": 3, "t": "é"}]
    put(tmp_path / "c.json", "\n".join(json.dumps(o, indent=1) for o in made))
    put(tmp_path / "d.json", json.dumps(made, indent=2))
    df = mr.read_json(spark, str(tmp_path), range_bytes=size)
    assert rows(df, "a", "t") == norm([(1, '}{"\\'), (2, None), (3, "é")] * 2)
    mixed = put(tmp_path / "x" / "m.json", '{"a":\n 1}\n[{"a": 2}]')
    with pytest.raises(Exception, match="side by side"):
        mr.read_json(spark, mixed, range_bytes=size).count()


def test_parquet_files_of_different_columns(spark, tmp_path):
    spark.range(2).selectExpr("id", "id as a").write.parquet(str(tmp_path / "p"))
    spark.range(3).selectExpr("id", "'z' as zz").write.mode("append").parquet(str(tmp_path / "p"))
    out = mr.read_any(spark, str(tmp_path / "p"))
    assert sorted(out.columns) == ["a", "id", "zz"] and out.count() == 5
    assert out.where("zz = 'z'").count() == 3


def test_open_quote_gives_lines_back(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("a.csv", 'id,t\n4,"p\nq"\n1,"abc\n2,x\n3,y\n')
    path = str(tmp_path / "o.zip")
    assert rows(mr.read_archive(spark, path)) == norm([(4, "p\nq"), (2, "x"), (3, "y")])
    bad = mr.archive_bad_lines(mr.members(spark, path))
    assert [r["line"] for r in bad.collect()] == ['1,"abc']


def test_members_in_several_encodings(spark, tmp_path):
    text = "id,t\n" + "".join(f"{i},caf\u00e9 {i}\n" for i in range(9))
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("a.csv", b"\xef\xbb\xbf" + text.encode())
        z.writestr("b.csv", (text + "9,\u20ac\n").encode("cp1252"))
        z.writestr("c.csv", text.encode("latin-1") + b"9,\x81\n")
        z.writestr("d.csv", "")
    found = mr.members(spark, str(tmp_path))
    got = {}
    for r in archives_module.member_lines(found).where("line_no > 0").collect():
        got.setdefault(r["name"], {})[r["line_no"]] = r["line"]
    want = {i + 1: f"{i},caf\u00e9 {i}" for i in range(9)}
    assert got == {"a.csv": want, "b.csv": want | {10: "9,\u20ac"}, "c.csv": want | {10: "9,\x81"}}
    heads = archives_module.member_heads(archives_module.member_lines(found))
    assert {r["name"]: r["header"] for r in heads.collect()} == {
        **dict.fromkeys(("a.csv", "b.csv", "c.csv"), ["id", "t"]), "d.csv": []}


def test_members_are_inflated_once(tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "id;t\n" + "".join(f"{i};\u00e9\n" for i in range(50_000)))
    read, plain = [], zipfile.ZipExtFile._read1
    monkeypatch.setattr(zipfile.ZipExtFile, "_read1",
                        lambda self, n: read.append(plain(self, n)) or read[-1])
    with zipfile.ZipFile(tmp_path / "m.zip") as z:
        records = list(archives_module.scanned(z, "a.csv"))
        assert sum(map(len, read)) == z.getinfo("a.csv").file_size
    assert len(records) == 50_001 and records[0] == (";", "id;t", False)


def test_inventory_goes_on_after_broken_files(spark, tmp_path):
    put(tmp_path / "a.csv", "x,y\n1,2\n")
    put(tmp_path / "b.zip", b"PK\x03\x04 no archive")
    put(tmp_path / "c.parquet", b"PAR1 cut")
    put(tmp_path / "d.xml", "<all><r><v>1</v></r>")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("i.json", '[{"k": 1},\n {"k": 2}]')
    seen = {r["file"]: (r["rows"], r["error"]) for r in mr.folder_inventory(spark, str(tmp_path)).collect()}
    assert seen["a.csv"] == (1, None) and seen["e.zip/i.json"] == (2, None)
    assert all(seen[f][0] == 0 and seen[f][1] for f in ("b.zip", "c.parquet", "d.xml"))
    assert len(seen) == 5


def test_members_of_many_archives_are_read_together(spark, tmp_path, monkeypatch):
    for i in range(4):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / f"d{i % 2}" / f"z{i // 2}.zip", "w") as z:
            z.writestr("i.json", f'{{"k": {i}}}\n{{"k": {10 + i}}}')
            z.writestr("x.xml", f"<all><r><k>{20 + i}</k></r></all>")
    read, plain = [], archives_module.read_json
    monkeypatch.setattr(archives_module, "read_json", lambda *a: read.append(a) or plain(*a))
    paths = [str(tmp_path / f"d{i % 2}" / f"z{i // 2}.zip") for i in range(4)]
    out = mr.union_members(spark, paths, source_column="src")
    assert rows(out, "k", "src") == norm([(str(k + i), f"z{i // 2}.zip") for i in range(4)
                                          for k in (0, 10, 20)])
    assert len(read) == 1


def test_xml_schema_from_few_files(spark, tmp_path):
    for i in range(40):
        put(tmp_path / f"{i}.xml", "<a>" + f"<r><x>{i}</x><x/><y>m <z>1</z></y></r>" * 3 + "</a>")
    put(tmp_path / "e.xml", "<a><r/><r><x> </x><w> </w></r></a>")
    shapes, plain = [], structured_module.per_file
    structured_module.per_file = lambda files, read, schema: shapes.append(plain(files, read, schema)) or shapes[-1]
    try:
        out = mr.read_xml(spark, str(tmp_path))
    finally:
        structured_module.per_file = plain
    assert rows(out, "x", "y", "z", "w") == norm([(None, "m", "1", None)] * 120 + [(None,) * 4] * 2)
    assert shapes[1].distinct().count() == 42 and shapes[1].select("shape").distinct().count() == 3


def test_inventory_reads_alike_members_together(spark, tmp_path, monkeypatch):
    made = {"a": '{"k": 1, "n": {"x": 1}}\n{"k": 2}', "b": '{"n": {"x": 5}, "k": "t"}',
            "c": '[{"k": 1},\n {"q": [1]}]', "d": '{"n": null}\n{"n": {}}', "e": '{"n": {"x": 1}}\n{"n": 7}'}
    for name, text in made.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("s.json", text)
            z.writestr("t.xml", f"<all><r><{name in 'ab'}>1</{name in 'ab'}></r></all>")
    read = {"json": [], "xml": []}
    for kind in read:
        plain = getattr(folders_module, f"read_{kind}")
        monkeypatch.setattr(folders_module, f"read_{kind}", lambda *a, _p=plain, _k=kind, **k:
                            read[_k].append(a) or _p(*a, **k))
    seen = {r["file"]: (r["rows"], r["columns"]) for r in mr.folder_inventory(spark, str(tmp_path)).collect()}
    assert seen == {"a.zip/s.json": (2, ["k", "n.x"]), "b.zip/s.json": (1, ["k", "n.x"]),
                    "c.zip/s.json": (2, ["k", "q"]), "d.zip/s.json": (2, []),
                    "e.zip/s.json": (2, ["n"])} | {
        f"{n}.zip/t.xml": (1, [str(n in "ab")]) for n in made}
    assert (len(read["json"]), len(read["xml"])) == (4, 2)


def test_ranges_of_many_files_are_read_once(spark, tmp_path):
    for i in range(30):
        put(tmp_path / f"{i}.csv", '\n\na,b\n' + "".join(f'{i},"x\n{j}"\n' for j in range(5)))
    reads = spark.sparkContext.accumulator(0)

    class Counted(Quotes):
        def records(self, *a):
            reads.add(1)
            return super().records(*a)

    plain = delimited_module.Quotes
    delimited_module.Quotes = Counted
    try:
        out = mr.read_delimited(spark, str(tmp_path), range_bytes=16).result
    finally:
        delimited_module.Quotes = plain
    assert rows(out) == norm([(i, f"x\n{j}") for i in range(30) for j in range(5)])
    ranges = sum(-(-p.stat().st_size // 16) for p in tmp_path.glob("*.csv"))
    assert reads.value == ranges


FEW = (folders_module, archives_module)


def test_many_files_are_united_without_their_names(spark, tmp_path, monkeypatch):
    """Delimited files and archives of JSON members, more than the driver should hold."""
    for module in FEW:
        monkeypatch.setattr(module, "FEW_FILES", 3, raising=False)
    for i in range(8):
        put(tmp_path / f"o {i}.csv", f"key;label\n{i};x\n")
        with zipfile.ZipFile(tmp_path / f"z{i}.zip", "w") as z:
            z.writestr("j.json", f'{{"key": {10 + i}}}\n')
    out = mr.union_folder(spark, str(tmp_path), source_tag="src")
    assert rows(out, "key", "label", "src") == norm(
        [(i, "x", f"o {i}.csv") for i in range(8)] + [(10 + i, None, f"z{i}.zip") for i in range(8)])
    read = [f.rsplit("/", 1)[-1] for f in out.inputFiles()]
    assert read and all(f.startswith("part-") for f in read)


def test_many_files_read_as_few(spark, tmp_path, monkeypatch):
    """Layouts, encodings, line ends, bad lines and forms of JSON: the same rows either way."""
    texts = ["﻿A,B\n1,2\n", "\n \t\nA;B\r\n3;4\r\r\n5;\r\n", 'A,B\n"x\ny",7\n', "", "A,B\n", ",,\n,,\n",
             "A,B\n8,9,10\n11\n\x0012,13", "A\tA\n1\t2\n", 'A,B\n5" z,NA\n"q""r",14\n', "A,C\n \n15, 16 \n\xa0\n"]
    for i, text in enumerate(texts):
        put(tmp_path / f"f {i}.csv", text)
    put(tmp_path / "w.csv", "A,é\n€,\x85\n")
    put(tmp_path / "v.csv", "A,é\n€,é\n".encode("cp1252"))
    put(tmp_path / "u.csv", b"A,\xe9\n\x81,\xe9\n")
    documents = ['{"A": 1}\n\n{"A": 2, "n": {"x": 1.5}}\r\n', '[{"A": 3}, {"A": 4}]', "[]", "{}", "",
                 '{"A":\n 5}\n{"A": 6, "t": "}{"}', '[\n{"A": 7},\n{"A": 8, "l": [1, 2]}]', '{"A": null}', '[1, 2]\n7\n[{"A": 9}, null]\n[{"A": 9}, 3]\n[{"A": 10}]']
    for i, text in enumerate(documents):
        put(tmp_path / f"d{i}.json", text)
        with zipfile.ZipFile(tmp_path / f"z{i}.zip", "w") as z:
            z.writestr("in/j.json", text)
            z.writestr("c.csv", texts[i])

    def united():
        out = mr.union_folder(spark, str(tmp_path), source_tag="src")
        return out.dtypes, norm(tuple(str(v) if isinstance(v, list) else v for v in r) for r in out.collect())

    few = united()
    assert len(few[1]) > 40
    for module in FEW:
        monkeypatch.setattr(module, "FEW_FILES", 0)
    many = united()
    assert many[0] == few[0]
    assert many[1] == few[1]


@pytest.mark.parametrize("size", [1, 2, 5, None])
def test_lines_by_ranges(spark, tmp_path, size):
    raw = b"\xef\xbb\xbfa,b\r\n\r\n1,\xe9\r2,x\n\n\x00\n \t\r\n3,\x85\xa0\r\r\n4,end"
    put(tmp_path / "a.csv", raw)
    put(tmp_path / "e.csv", b"")
    found = records(spark, list_folder(spark, str(tmp_path)), Lines(), "latin-1", size).collect()
    assert [r["value"] for r in sorted(found, key=lambda r: (r["low"], r["no"]))] == [
        "a,b", "1,\xe9", "2,x", "3,\x85\xa0", "4,end"]


def test_folder_listed_by_a_task(spark, tmp_path):
    for name in ("a b.csv", "c+d.TSV", "n", "_hidden", ".crc", "_metadata", "_k=1.csv", "é%20.zip", "x._COPYING_"):
        put(tmp_path / "in" / name, name)
    put(tmp_path / "in" / "empty.csv", "")
    put(tmp_path / "in" / "sub" / "deep.csv", "x")
    put(tmp_path / "parts" / "k=1" / "p.csv", "x")
    put(tmp_path / "deep" / "d" / "k=1" / "p.csv", "x")
    for path in (tmp_path / "in", f"file:{tmp_path}/in/", tmp_path / "parts", tmp_path / "deep",
                 tmp_path / "in" / "*.csv", tmp_path / "in" / "n"):
        assert rows(list_folder(spark, str(path))) == rows(listing(spark, str(path)).drop("modified"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_folder(spark, str(tmp_path / "gone"))
