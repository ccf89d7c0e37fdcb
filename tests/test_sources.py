import zipfile

import pytest
from pyspark.sql import functions as F

from duelspark.operators import canonical
from duelspark.sources import artifacts, seasons, statistics
from duelspark.streaming import prices

HEADER = "Date,Tournament,Surface,Round,Best of,Winner,Loser,WRank,LRank,B365W,B365L,AvgW,AvgL,PSW,PSL,Comment"


def sheet(path, rows):
    """A minimal workbook: shared strings, numbers and one date style."""
    strings, cells = [], []
    for n, row in enumerate(rows, 1):
        out = []
        for k, value in enumerate(row):
            ref = f"{chr(65 + k)}{n}"
            if isinstance(value, tuple):
                out.append(f'<c r="{ref}" s="1"><v>{value[0]}</v></c>')
            elif isinstance(value, (int, float)):
                out.append(f'<c r="{ref}"><v>{value}</v></c>')
            elif value is not None:
                strings.append(value)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
        cells.append(f'<row r="{n}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + "\n2024-01-02,Brisbane,Hard,1st Round,3,Player  One,Player Two,12,NR,1.80,2.10,,,1.0,abc,Completed\n"
        "03/01/2024,Brisbane,Clay,The Final,5,Zed A.,Abe Z.,,-,N/A,2.0,1.9,1.95,,,Retired\n"
        "bad-date,Brisbane,Hard,F,3,X,Y,1,2,,,,,,,\n2024-01-02,Brisbane,Hard,F,3,W,V,1,2,,,,,,,W/O\n"
    )
    (tmp_path / "b.csv").write_text("Date,Winner\n2024-01-01,A\n")
    (tmp_path / "sub").mkdir()
    sheet(tmp_path / "sub" / "c.xlsx", [["Date", "Event", "surface", "Winner", "Loser", "BestOf", "Status"], [(45293,), "Perth", "Grass", "Ann", "Bob", 3, None], [(45294,), "Perth", "Grass", "Cy", None, 5, "x"]])
    (tmp_path / "notes.txt").write_text("no")
    return tmp_path


def test_ingest_isolates_files_and_maps_headers(spark, folder):
    got = seasons.ingest(spark, str(folder))
    assert got.files == ("a.csv", "c.xlsx") and [e.missing for e in got.errors] == [("tournament", "surface", "loser")]
    rows = {(r["source_file"], r["winner"]): r for r in got.data.collect()}
    one, two = rows["a.csv", "Player  One"], rows["a.csv", "Zed A."]
    assert (one["odds_source"], one["winner_odds"], one["loser_rank"], one["ps_pair_available"]) == ("B365", 1.8, None, False)
    assert (two["odds_source"], two["winner_odds"], two["loser_b365_odds"]) == ("Average", 1.9, 2.0)
    ann = rows["c.xlsx", "Ann"]
    assert (str(ann["match_date"]), ann["best_of"], ann["tournament"]) == ("2024-01-02", 3, "Perth")
    report = got.report.first()
    assert (report["rows_returned"], report["rows_with_invalid_dates"], report["rows_without_odds"], report["files_failed"]) == (6, 1, 4, 1)


def test_clean_ingested_rows(spark, folder):
    cleaned = canonical.clean(seasons.ingest(spark, str(folder)).data)
    assert {r["rejection_reason"] for r in cleaned.rejected.collect()} == {"invalid_match_date", "walkover", "missing_loser"}
    rows = {r["tournament"]: r for r in cleaned.matches.collect() if r["tournament"] == "Perth" or r["is_retirement"]}
    assert rows["Brisbane"]["player_1"] == "Abe Z." and rows["Brisbane"]["player_1_won"] is False and rows["Brisbane"]["player_1_odds"] == 1.95
    report = cleaned.report.first()
    assert report["rows_received"] == 6 and report["rows_accepted"] == 3 and report["rejections"]["walkover"] == 1


def test_empty_folder_and_unreadable(spark, tmp_path):
    assert seasons.ingest(spark, str(tmp_path / "none")).data.count() == 0
    (tmp_path / "x.xlsx").write_text("not a zip")
    (tmp_path / "y.xls").write_text("old")
    assert len(seasons.ingest(spark, str(tmp_path)).errors) == 2
    with pytest.raises(seasons.NoRows):
        seasons.ingest(spark, str(tmp_path), fail_if_no_rows=True)
    assert seasons.odds_columns(["B365W", "PSL", "MaxW", "Winner", "AvgL"]) == ["B365W", "PSL", "MaxW", "AvgL"]


def test_statistics_files(spark, tmp_path):
    (tmp_path / "atp_matches_2024.csv").write_text("tourney_id,tourney_name,surface,tourney_date,match_num,winner_id,winner_name,loser_id,loser_name,score,best_of,round,w_ace\n2024-1,Rome,clay,20240501,1,5,Jannik Sinner,6,Casper Ruud,6-4 RET,3,F,7\n")
    loaded = statistics.load(spark, str(tmp_path))
    row = loaded.matches.first()
    assert row["is_retirement"] and not row["is_walkover"] and row["surface"] == "Clay" and row["winner_ace"] == 7 and row["minutes"] is None
    assert "minutes" in loaded.missing_columns["atp_matches_2024.csv"] and "sinner j" in row["winner_keys"]
    (tmp_path / "alias.csv").write_text("name,id\nSinner J.,5\n")
    assert statistics.load_aliases(spark, str(tmp_path / "alias.csv")).first()["name"] == "sinner j"
    assert statistics.load_aliases(spark, str(tmp_path / "none.csv")) is None


def test_artifacts(spark, tmp_path):
    frame = spark.createDataFrame([(1, {"a": 1}), (2, None)], "k long, m map<string,long>")
    paths = artifacts.write_bundle({"t.parquet": frame, "t.csv": frame, "t.json": frame}, str(tmp_path))
    assert spark.read.parquet(paths["t.parquet"]).count() == 2 and spark.read.csv(paths["t.csv"], header=True).count() == 2
    assert artifacts.file_hashes(spark, paths["t.parquet"]).filter(F.length("sha256") == 64).count() >= 1
    assert {r["bin"]: r["n"] for r in artifacts.histogram(frame, "k", 0, 2, 2).collect()} == {1: 2}


def test_stream_equals_batch(spark, tmp_path):
    frame = spark.range(300).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (1.5 + F.col("id") % 7 / 10).alias("a"), (2.0 + F.col("id") % 3 / 10).alias("b"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = prices.windowed_overround(stream, "ts", ("a", "b")).writeStream.outputMode("complete").format("memory").queryName("prices").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("prices").collect()))
    want = sorted(map(tuple, prices.windowed_overround(frame, "ts", ("a", "b")).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 13
