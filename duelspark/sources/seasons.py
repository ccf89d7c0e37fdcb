"""Heterogeneous season files to one relation of raw matches.

Everything is read as text; each file's headers are matched through an alias table; a file that lacks a
required field is reported and left out, the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from .workbook import Workbook

EXTENSIONS = (".csv", ".xls", ".xlsx")
REQUIRED = ("match_date", "tournament", "surface", "winner", "loser")
# Header spellings by field, in order of preference.
ALIASES = {
    "match_date": ("Date", "MatchDate", "match_date"),
    "tournament": ("Tournament", "Tournament Name", "Event", "tourney_name"),
    "surface": ("Surface",),
    "round": ("Round",),
    "best_of": ("Best of",),
    "winner": ("Winner",),
    "loser": ("Loser",),
    "winner_rank": ("WRank", "Winner Rank", "winner_ranking"),
    "loser_rank": ("LRank", "Loser Rank", "loser_ranking"),
    "status_or_comment": ("Comment", "Status", "Result"),
}
# Winner and loser price columns by book, and the books that may give the match's odds.
BOOK_COLUMNS = {"b365": ("B365W", "B365L"), "ps": ("PSW", "PSL"), "avg": ("AvgW", "AvgL"), "max": ("MaxW", "MaxL")}
PREFERRED = (("B365W", "B365L", "B365"), ("AvgW", "AvgL", "Average"))


@dataclass(frozen=True)
class FileError:
    source_file: str
    message: str
    missing: tuple[str, ...] = ()
    available: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ingested:
    data: DataFrame
    report: DataFrame
    files: tuple[str, ...]
    errors: tuple[FileError, ...] = field(default=())


class NoRows(RuntimeError):
    """No file gave a row."""


def discover(folder: str) -> list[Path]:
    root = Path(folder)
    return sorted(p for p in root.rglob("*") if p.is_file() and p.suffix.casefold() in EXTENSIONS) if root.is_dir() else []


def header_key(name: str) -> str:
    return "".join(c for c in name.casefold() if c.isalnum())


def map_headers(columns: list[str]) -> dict[str, str]:
    """field -> column; of columns with one key the later stands."""
    by_key = {header_key(c): c for c in columns}
    return {f: next(by_key[header_key(a)] for a in names if header_key(a) in by_key) for f, names in ALIASES.items() if any(header_key(a) in by_key for a in names)}


def odds_columns(columns: list[str]) -> list[str]:
    """Headers that look like prices: side suffix and a book's prefix."""
    keys = {c: header_key(c) for c in columns}
    return [c for c, k in keys.items() if k[-1:] in ("w", "l") and k.startswith(("b36", "avg", "max", "ps"))]


def read_file(spark: SparkSession, path: Path) -> DataFrame:
    if path.suffix.casefold() == ".csv":
        return spark.read.csv(str(path), header=True, inferSchema=False, emptyValue="", nullValue="\x00", enforceSchema=True)
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").load(str(path))


def _odds(lookup: dict[str, str], name: str) -> Column:
    column = lookup.get(header_key(name))
    return N.valid_odds(N.number(F.col(f"`{column}`"))) if column else F.lit(None).cast("double")


def map_frame(frame: DataFrame, source_file: str, extra: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """One file's columns under canonical names, parsed."""
    found, lookup = map_headers(frame.columns), {header_key(c): c for c in frame.columns}
    raw = lambda f: F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")
    text = lambda f: F.trim(raw(f))
    pairs = [F.when(_odds(lookup, w).isNotNull() & _odds(lookup, l).isNotNull(), F.struct(_odds(lookup, w).alias("w"), _odds(lookup, l).alias("l"), F.lit(s).alias("s"))) for w, l, s in (*PREFERRED, *extra)]
    chosen = F.coalesce(*pairs)
    books = []
    for b, (w, l) in BOOK_COLUMNS.items():
        books += [_odds(lookup, w).alias(f"winner_{b}_odds"), _odds(lookup, l).alias(f"loser_{b}_odds"), (_odds(lookup, w).isNotNull() & _odds(lookup, l).isNotNull()).alias(f"{b}_pair_available")]
    return frame.select(
        N.parse_date(raw("match_date")).alias("match_date"),
        text("tournament").alias("tournament"),
        text("surface").alias("surface"),
        text("round").alias("round"),
        N.number(raw("best_of")).cast("long").alias("best_of"),
        text("winner").alias("winner"),
        text("loser").alias("loser"),
        N.number(raw("winner_rank")).cast("long").alias("winner_rank"),
        N.number(raw("loser_rank")).cast("long").alias("loser_rank"),
        chosen["w"].alias("winner_odds"),
        chosen["l"].alias("loser_odds"),
        F.coalesce(chosen["s"], F.lit("Missing")).alias("odds_source"),
        *books,
        text("status_or_comment").alias("status_or_comment"),
        F.lit(source_file).alias("source_file"),
        F.monotonically_increasing_id().alias("row_index"),
    )


def ingest(spark: SparkSession, folder: str, extra_pairs: tuple[tuple[str, str], ...] = (), fail_if_no_rows: bool = False) -> Ingested:
    extra = tuple((w, l, "ConfiguredBookmaker") for w, l in extra_pairs)
    parts, errors, files = [], [], []
    for k, path in enumerate(discover(folder)):
        try:
            frame = read_file(spark, path)
            missing = tuple(f for f in REQUIRED if f not in map_headers(frame.columns))
            if missing:
                errors.append(FileError(path.name, f"missing required fields: {', '.join(missing)}", missing, tuple(frame.columns)))
                continue
            parts.append(map_frame(frame, path.name, extra).withColumn("row_index", F.lit(k << 40) + F.col("row_index")))
            files.append(path.name)
        except Exception as problem:  # one unreadable file doesn't stop the others; it is reported
            errors.append(FileError(path.name, str(problem)[:500]))
    empty = spark.createDataFrame([], "match_date date, tournament string, surface string, round string, best_of long, winner string, loser string, winner_rank long, loser_rank long, winner_odds double, loser_odds double, odds_source string, " + ", ".join(f"winner_{b}_odds double, loser_{b}_odds double, {b}_pair_available boolean" for b in BOOK_COLUMNS) + ", status_or_comment string, source_file string, row_index long")
    data = reduce(DataFrame.unionByName, parts) if parts else empty
    report = data.agg(
        F.count(F.lit(1)).alias("rows_returned"),
        F.count_if(F.col("match_date").isNull()).alias("rows_with_invalid_dates"),
        F.count_if(F.col("odds_source") == "Missing").alias("rows_without_odds"),
        F.count_if(F.col("winner_rank").isNull() | F.col("loser_rank").isNull()).alias("rows_without_rankings"),
    ).select("*", F.lit(len(files) + len(errors)).alias("files_discovered"), F.lit(len(files)).alias("files_loaded"), F.lit(len(errors)).alias("files_failed"))
    if fail_if_no_rows and data.isEmpty():
        raise NoRows(f"no rows in {folder}")
    return Ingested(data, report, tuple(files), tuple(errors))
