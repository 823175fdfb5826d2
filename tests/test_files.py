from datetime import date

from tableinsight.plans.analyze import analyze, write_report
from tableinsight.session import fresh_path, shuffle_partitions
from tableinsight.sources.csv import (
    CSV_WRITE,
    Dialect,
    detect_dialects,
    load_csv,
    read_csv,
    read_csv_robust,
    read_many_robust,
)
from tableinsight.sources.catalog import preview
from tableinsight.sources.export import (
    export_names,
    markdown_report,
    write_cleaned,
    write_described,
    write_tables,
)
from tableinsight.sources.files import file_row_counts


def test_load_csv_infers_types(spark, tmp_path):
    path = tmp_path / "my-data.csv"
    path.write_text("id,day,price,name\n1,2024-01-05,2.5,a\n2,2024-01-06,3,\n")
    loaded = load_csv(spark, str(path))
    assert (loaded.name, loaded.row_count, loaded.n_columns) == ("my_data", 2, 4)
    assert dict(loaded.frame.dtypes) == {"id": "bigint", "day": "date", "price": "double", "name": "string"}
    assert spark.table("my_data").orderBy("id").collect()[1].name is None
    assert load_csv(spark, str(path), "other").name == "other"


FILES = {
    "semicolon_bom.csv": ("nom;prix\nA;1,5\nB;2,5\n".encode("utf-8-sig"), Dialect("utf-8-sig", ";")),
    "comma.csv": ("nom,prix\nA,1\n".encode(), Dialect("utf-8-sig", ",")),
    "latin.csv": ("nom,ville\nCafé,Orléans\n".encode("latin-1"), Dialect("latin-1", ",")),
    "tab.csv": ("nom\tprix\nA, B\t1\nC\t2\n".encode(), Dialect("utf-8-sig", "\t")),
    "pipe.csv": (b"nom|prix\nA|1\n", Dialect("utf-8-sig", "|")),
    "single.csv": (b"nom\nAlice\nBob\n", Dialect("utf-8-sig", ",")),
}


def test_dialects(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content)
    found = detect_dialects(spark, [str(tmp_path / name) for name in FILES])
    assert {k.rsplit("/", 1)[1]: v for k, v in found.items()} == {k: v for k, (_, v) in FILES.items()}


def test_robust_read(spark, tmp_path):
    for name, (content, _) in FILES.items():
        (tmp_path / name).write_bytes(content)
    frame, encoding = read_csv_robust(spark, str(tmp_path / "latin.csv"))
    assert encoding == "latin-1" and tuple(frame.first()) == ("Café", "Orléans")
    frame, encoding = read_csv_robust(spark, str(tmp_path / "semicolon_bom.csv"))
    assert encoding == "utf-8-sig" and frame.columns == ["nom", "prix"]
    assert sorted(map(tuple, frame.collect())) == [("A", "1,5"), ("B", "2,5")]
    both = read_many_robust(spark, [str(tmp_path / n) for n in ("comma.csv", "pipe.csv", "latin.csv")])
    assert both.columns == ["nom", "prix", "ville"] or set(both.columns) == {"nom", "prix", "ville"}
    assert both.count() == 3
    for name, text in (("my file 1%.csv", "a;b\n1;x\n"), ("my lines 2%.csv", 'a;b\n1;"x\ny"\n')):
        (tmp_path / name).write_text(text)
        assert file_row_counts(spark, [str(tmp_path / name)]).first().n == 1
    assert read_many_robust(spark, [str(tmp_path / "my file 1%.csv")]).columns == ["a", "b"]


def test_leading_zeros_survive_the_robust_read(spark, tmp_path):
    (tmp_path / "zip.csv").write_text("zip\n00501\n")
    assert read_csv_robust(spark, str(tmp_path / "zip.csv"))[0].first().zip == "00501"


def test_a_folder_of_parts_counts_as_one(spark, tmp_path):
    spark.range(0, 50, 1, 4).write.parquet(str(tmp_path / "my table 1%.parquet"))
    spark.range(0, 30, 1, 3).selectExpr("id", "concat(id, ' %') AS note").write.options(**CSV_WRITE).csv(
        str(tmp_path / "lines.csv")
    )
    spark.range(7).coalesce(1).write.json(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*.json")
    paths = [f"{tmp_path}/my table 1%.parquet/", f"file:{tmp_path}/lines.csv", str(part)]
    counts = {r.path.rsplit("/", 1)[1]: r.n for r in file_row_counts(spark, paths).collect()}
    assert counts == {"my%20table%201%25.parquet": 50, "lines.csv": 30, part.name: 7}
    found = file_row_counts(spark, [f"{tmp_path}/lines.csv/part-*.csv"]).collect()
    assert (len(found), sum(r.n for r in found)) == (3, 30)


def test_row_counts(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n3,4\n\n")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "quoted.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi""\n\nthere"\n3,z\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "lines.JSON").write_text('{"a": 1}\n{"a": 2}\n')
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    (parquet,) = (tmp_path / "p").glob("*.parquet")
    paths = [str(p) for p in [*tmp_path.glob("*.csv"), tmp_path / "lines.JSON", parquet]]
    counts = {r.path.rsplit("/", 1)[1]: r.n for r in file_row_counts(spark, paths).collect()}
    assert counts == {"plain.csv": 2, "header.csv": 0, "quoted.csv": 3, "lines.JSON": 2, parquet.name: 5}
    assert file_row_counts(spark, []).count() == 0


def test_export_names():
    assert export_names(["../../evil.csv", "A.CSV", "a.csv", "dir\\b.csv"]) == [
        "evil_nettoye", "A_nettoye", "a_nettoye_2", "b_nettoye",
    ]


def test_write_cleaned_is_spreadsheet_safe(spark, tmp_path):
    frame = spark.createDataFrame([('=1+1 "x", y', 1)], "t string, n int")
    (path,) = write_cleaned({"in.csv": frame}, str(tmp_path / "out"))
    assert path.endswith("/out/in_nettoye")
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert back.t == "'=1+1 \"x\", y"


def test_report(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, date(2024, 1, 1 + i % 20), "ab"[i % 2]) for i in range(40)], "user_id int, day date, kind string"
    )
    paths = write_report(analyze(df), str(tmp_path / "r"), "why?", {"in.csv": 40}, "now")
    assert spark.read.parquet(paths["metric"]).count() == 3
    assert set(spark.read.parquet(paths["drivers"]).columns) == {"dimension", "category", "n"}
    text = "\n".join(r.value for r in spark.read.text(paths["report"]).collect())
    assert "- in.csv : 40 lignes" in text and "kind : p=1.0 (non significatif)" in text
    csv = write_report(analyze(df), str(tmp_path / "c"), "why?", {}, "now", fmt="csv")
    assert spark.read.option("header", True).csv(csv["validation"]).count() == 3


def test_markdown():
    text = markdown_report("q", {"f": 3}, ["x"], "t")
    assert text.splitlines()[0] == "# Rapport d'analyse : t" and text.endswith("- x")


def test_session_settings(spark):
    assert shuffle_partitions(100 * 2**40, 8) == 819_200
    assert shuffle_partitions(1, 8) == 8
    shared = spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(shared) and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_described_data(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "n int, kind string")
    paths = write_described({"in.csv": df}, str(tmp_path / "d"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["data", "stats_numbers"]
    assert spark.read.parquet(paths[1]).first().p50 == 2.0
    assert preview(df, 3).count() == 3


def test_quoted_line_breaks_across_blocks(spark, tmp_path):
    body = "".join(f'{i};"first ""{i}""\n\nlast {i}"\n' for i in range(200))
    (tmp_path / "q.csv").write_text("a;b\n" + body)
    settings = {"spark.sql.files.maxPartitionBytes": "301", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.text(str(tmp_path / "q.csv")).rdd.getNumPartitions() > 5
        assert file_row_counts(spark, [str(tmp_path / "q.csv")]).first().n == 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


TRICKY = ['say "hi", you', "two\nlines", "  edges  ", 'back\\slash "\\" end\\', "", "a;b\tc|d", "tail\n", '"', "é\r\nù"]


def test_texts_survive_a_round_trip(spark, tmp_path):
    """To the character; only an empty text comes back as a missing one."""
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    for name, frame in (("broken", df), ("plain", df.where("instr(t, '\n') = 0"))):
        path = str(tmp_path / name)
        frame.write.options(**CSV_WRITE).csv(path)
        expected = sorted((r.id, r.t or None) for r in frame.collect())
        assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == expected
        texts = read_csv_robust(spark, path)[0]
        assert sorted((int(r.id), r.t) for r in texts.collect()) == expected
        counted = file_row_counts(spark, [str(p) for p in (tmp_path / name).glob("part-*.csv")])
        assert sum(r.n for r in counted.collect()) == len(expected)


def test_accents_before_the_separator_and_mixed_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nom;ville\ncafé;2\nthé;3\n".encode("latin-1"))
    frame, encoding = read_csv_robust(spark, str(tmp_path / "a.csv"))
    assert encoding == "latin-1" and sorted(map(tuple, frame.collect())) == [("café", "2"), ("thé", "3")]
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "p0.csv").write_bytes(b"nom;n\necole;1\n")
    (folder / "p1.csv").write_bytes("nom;n\nécole;2\n".encode("latin-1"))
    frame, encoding = read_csv_robust(spark, str(folder))
    assert encoding == "latin-1" and sorted(map(tuple, frame.collect())) == [("ecole", "1"), ("école", "2")]


def test_files_without_rows_count_zero(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "p.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "q.parquet"))
    (tmp_path / "j.json").write_text("\n")
    (tmp_path / "h.csv").write_text("a,b\n")
    paths = [str(tmp_path / n) for n in ("p.parquet", "q.parquet", "j.json", "h.csv")]
    found = {}
    for r in file_row_counts(spark, paths).collect():
        name = next(n for n in ("p.parquet", "q.parquet", "j.json", "h.csv") if n in r.path)
        found[name] = found.get(name, 0) + r.n
    assert found == {"p.parquet": 0, "q.parquet": 3, "j.json": 0, "h.csv": 0}


def test_parquet_keeps_values_that_csv_neutralises(spark, tmp_path):
    table = spark.createDataFrame([("-1",), ("=x",)], "category string")
    paths = write_tables({"t": table}, str(tmp_path / "parquet"))
    assert sorted(r.category for r in spark.read.parquet(paths["t"]).collect()) == ["-1", "=x"]
    paths = write_tables({"t": table}, str(tmp_path / "csv"), "csv")
    assert sorted(r.category for r in read_csv(spark, paths["t"]).collect()) == ["'-1", "'=x"]
