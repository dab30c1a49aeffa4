"""Reading and writing."""

from __future__ import annotations

import pytest
import small
from pyspark.sql import types as T

from uptakelens.settings import Settings
from uptakelens.sources import readers, reports, schemas, writers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_missing_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,n\n1,NA,5\n2,"",NA\n3,,7\n4,"NA-NA",8\n')
    schema = T.StructType(
        [
            T.StructField("id", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    )
    found = {r["id"]: (r["name"], r["n"]) for r in readers.read_csv_na(spark, path, schema).collect()}
    assert found == {1: (None, 5), 2: ("", None), 3: (None, 7), 4: ("NA-NA", 8)}


def test_csv_columns_go_by_name(spark, tmp_path):
    path = write(tmp_path / "lookup.csv", '"",Constituency,extra,LSOA,IMD_quintile,Locality\n"1",N,x,a1,NA,l\n')
    row = readers.read_lookup(spark, path).first()
    assert row.asDict() == {
        "area": "a1",
        "locality": "l",
        "imd_quintile": None,
        "constituency": "N",
    }


def test_csv_with_a_missing_column(spark, tmp_path):
    path = write(tmp_path / "lookup.csv", "LSOA,Locality\na,b\n")
    with pytest.raises(ValueError, match="IMD_quintile"):
        readers.read_lookup(spark, path)


def test_csv_with_a_wrong_value_fails(spark, tmp_path):
    path = write(tmp_path / "lookup.csv", "LSOA,Locality,IMD_quintile,Constituency\na,b,one,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_lookup(spark, path).collect()


def test_event_and_register_files(spark, tmp_path):
    header = ",".join([*schemas.EXTRACT_COLUMNS, "TimePeriod"])
    line = "act,p,s,1st,c,A: British,pc,45,45-49,Female,a1,Oct"
    events = readers.read_events(spark, write(tmp_path / "events.csv", f"{header}\n{line}\n"))
    row = events.first()
    assert (row["group_raw"], row["age"], row["age_band"], row["sex"], row["area"]) == (
        "A: British",
        45.0,
        "45-49",
        "Female",
        "a1",
    )
    text = "LSOA_2011,AgeBand,Ethnic_Description_National,Gender,Observations\na1,0-4,Irish,Male,NA\n"
    register = readers.read_register(spark, write(tmp_path / "register.csv", text))
    assert register.first().asDict() == {
        "area": "a1",
        "age_band": "0-4",
        "group_national": "Irish",
        "sex": "Male",
        "observations": None,
    }


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_window_is_half_open(spark, kind):
    days = ["2023-09-30", "2023-10-01", "2024-09-30", "2024-10-01"]
    frame = spark.createDataFrame([(day,) for day in days], "day string").selectExpr(
        f"CAST(day AS {kind}) AS vaccination_date", "day AS action"
    )
    found = readers.extract_events(frame, columns=["action"])
    assert sorted(r["action"] for r in found.collect()) == ["2023-10-01", "2024-09-30"]
    assert found.columns == ["action", "time_period"]
    assert found.first()["time_period"] == "Oct 23 - Sept 24"


def test_window_rejects_text_that_is_no_date(spark):
    frame = spark.range(1).selectExpr("current_date() AS d")
    with pytest.raises(ValueError):
        readers.in_window(frame, "d", "2023-10-01' OR '1'='1", "2024-01-01")


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x", "s.v", "day", "2023-10-01", "2024-10-01", 12)
    assert options["numPartitions"] == "12"
    assert options["partitionColumn"] == "day"
    assert options["pushDownPredicate"] == "true"


def test_results_and_sheets(spark, tmp_path):
    frame = spark.createDataFrame(
        [("White and Asian", "N", 1.5), ("White-and-Asian", "S", 2.5), ("All", None, None)],
        "label string, place string, v double",
    )
    path = writers.write_results(frame, str(tmp_path / "r"), "csv", names={"v": "value"})
    lines = sorted(
        line for part in (tmp_path / "r").glob("part-*") for line in part.read_text().splitlines()
    )
    assert set(lines) == {
        "All,NA,NA", "White and Asian,N,1.5", "White-and-Asian,S,2.5", "label,place,value",
    }
    sheets = writers.write_sheets(frame, str(tmp_path / "sheets"), ["label"])
    assert path and len(list((tmp_path / "sheets").glob("label=*"))) == 3
    found = spark.read.option("header", True).csv(sheets).select("label", "sheet").collect()
    assert sorted(map(tuple, found)) == [
        ("All", "All"),
        ("White and Asian", "White-and-Asian"),
        ("White-and-Asian", "White-and-Asian"),
    ]


def test_csv_files_of_a_folder_must_have_one_header(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", "LSOA,Locality,IMD_quintile,Constituency\na1,loc1,1,c\n")
    write(tmp_path / "in" / "2.csv", "Locality,LSOA,IMD_quintile,Constituency\nloc2,a2,2,c\n")
    rows = readers.read_lookup(spark, str(tmp_path / "in"))
    with pytest.raises(Exception, match="(?i)header"):
        rows.collect()
    with pytest.raises(Exception, match="(?i)header"):
        rows.select("area").collect()


def test_shared_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    application = spark.sparkContext.applicationId
    assert writers.shared_folder(spark) == f"{folder}/uptakelens-{application}"


def test_whole_report(spark, tmp_path):
    folder = str(tmp_path / "report")
    settings = Settings(require_matrix_labels=False)
    study = small.study(spark, settings=settings)
    scratch = tmp_path / "scratch"
    written = study.write(spark, folder, strict_nulls=False, scratch=str(scratch))
    assert len(written) == 27
    assert not list(scratch.glob("*"))  # what it wrote on the way is gone
    found = reports.read_report(spark, folder)
    assert set(found) == set(written)
    assert dict(found["gap_matrix_by_sex"].dtypes)["Indian"] == "string"  # small numbers are hidden
    assert found["gap_matrix_by_sex"].filter("Indian = '<5'").count() > 0
    assert found["gap_matrix_protected"].filter("`All` = '*'").count() > 0
    more = study.tables(unsuppressed=True)
    assert {"gap_counts_by_sex", "gap_margins_both"} < set(more)
    assert found["rates.csv"].columns == [
        "Ethnicity", "IMD_quintile", "Sex", "Age_Group", "n", "N_GP", "p_GP", "perc_GP", "Z",
        "LowerCI95", "UpperCI95",
    ]
    counts = spark.read.option("header", True).csv(written["unvaccinated_counts.csv"])
    assert "number_unvaxed" in counts.columns
    assert counts.filter("Ethnicity = 'NA'").count() == 1  # outside the vocabulary
    assert found["area_layer"].count() == 30
    direct = study.tables(strict_nulls=False)
    for name, entry in reports.entries(spark, folder).items():
        assert entry.rows == found[name].count()
        if name in direct:
            assert sorted(map(repr, found[name].collect())) == sorted(map(repr, direct[name].collect()))
    shares = {(r.ord, r.constituency): r.share for r in direct["constituency_share"].collect()}
    assert {(r.ord, r.constituency): r.share for r in found["constituency_sheets"].collect()} == shares


def job(frame):
    return frame, "parquet", writers.write_results


def test_a_report_that_fails_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        reports.read_report(spark, folder)
    good = {"a": job(spark.range(5)), "b": job(spark.range(3))}
    reports.write_report(spark, folder, good)
    broken = spark.range(10).selectExpr("IF(id = 7, CAST(raise_error('broken') AS BIGINT), id) AS id")
    with pytest.raises(Exception, match="broken"):
        reports.write_report(spark, folder, {"a": job(spark.range(50)), "b": job(broken), "c": job(spark.range(1))})
    held = reports.read_report(spark, folder)
    assert {n: f.count() for n, f in held.items()} == {"a": 5, "b": 3}
    assert len(list((tmp_path / "report" / "runs").iterdir())) == 1  # the failed run is gone
    with pytest.raises(ValueError, match="lacks"):
        reports.read_report(spark, folder, "c")


def test_reports_replace_each_other(spark, tmp_path):
    folder = str(tmp_path / "report")
    first = reports.write_report(spark, folder, {"a": job(spark.range(1))})
    open_table = reports.read_report(spark, folder, "a")["a"]
    for n in (2, 3):
        reports.write_report(spark, folder, {"a": job(spark.range(n))})
        assert reports.read_report(spark, folder)["a"].count() == n
        if n == 2:  # what a reader has open stays for one more run
            assert open_table.count() == 1
    runs = {p.name for p in (tmp_path / "report" / "runs").iterdir()}
    assert len(runs) == 2 and not any(first["a"].split("/")[-2] == r for r in runs)
    assert not [p for p in (tmp_path / "report").iterdir() if p.is_file() and p.name.startswith("CURRENT.")]


def test_a_report_keeps_types_and_missing_values(spark, tmp_path):
    rows = [("x", None, 1.5, 2), (None, "", None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c double, d int")
    as_csv = (frame, "csv", lambda f, path: writers.write_results(f, path, "csv"))
    folder = str(tmp_path / "report")
    reports.write_report(spark, folder, {"p": job(frame), "c": as_csv, "none": job(frame.filter("false"))})
    found = reports.read_report(spark, folder)
    assert all(f.dtypes == frame.dtypes for f in found.values())
    assert sorted(map(tuple, found["c"].collect()), key=repr) == sorted(rows, key=repr)
    assert found["none"].count() == 0


LOOKUP_HEADER = "LSOA,Locality,IMD_quintile,Constituency,note\n"
BAD = ["a2,b,one,c,x", "a3,b", "a4,b,2,c,x,too many", "a5,b,2.5,c,x"]
GOOD = ["a1,loc,1,c,x", 'a6,"",NA,c,x', "a7,,3,NA,x"]


def quarantined(spark, folder):
    return {(r.record, r.file.split("/")[-1]) for r in spark.read.parquet(folder).collect()}


def test_unreadable_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", LOOKUP_HEADER + "\n".join([GOOD[0], *BAD[:2], GOOD[1]]) + "\n")
    write(tmp_path / "in" / "2.csv", LOOKUP_HEADER + "\n".join([*BAD[2:], GOOD[2]]) + "\n")
    aside = str(tmp_path / "aside")
    rows = readers.read_lookup(spark, str(tmp_path / "in"), readers.Quarantine(aside, most=0.6))
    assert rows.columns == ["area", "locality", "imd_quintile", "constituency"]
    assert sorted(map(tuple, rows.collect())) == [
        ("a1", "loc", 1, "c"), ("a6", "", None, "c"), ("a7", None, 3, None),
    ]
    assert quarantined(spark, aside) == {(BAD[0], "1.csv"), (BAD[1], "1.csv"), (BAD[2], "2.csv"), (BAD[3], "2.csv")}
    # what is set aside doesn't depend on what is read of the rest
    assert rows.select("area").count() == 3


def test_too_many_unreadable_rows_fail_the_read(spark, tmp_path):
    path = write(tmp_path / "lookup.csv", LOOKUP_HEADER + "\n".join([*GOOD, BAD[0]]) + "\n")
    aside = str(tmp_path / "aside")
    with pytest.raises(ValueError, match="1 of 4 rows"):
        readers.read_lookup(spark, path, readers.Quarantine(aside, most=0.2))
    assert quarantined(spark, aside) == {(BAD[0], "lookup.csv")}
    assert readers.read_lookup(spark, path, readers.Quarantine(aside, most=0.25)).count() == 3
    assert len(spark.read.parquet(aside).collect()) == 2  # of both reads


def test_files_without_unreadable_rows(spark, tmp_path):
    path = write(tmp_path / "lookup.csv", LOOKUP_HEADER + "\n".join(GOOD) + "\n")
    aside = tmp_path / "aside"
    assert readers.read_lookup(spark, path, readers.Quarantine(str(aside), most=0)).count() == 3
    assert not aside.exists()
    empty = write(tmp_path / "empty.csv", LOOKUP_HEADER)
    assert readers.read_lookup(spark, empty, readers.Quarantine(str(aside))).collect() == []
    other = write(tmp_path / "other.csv", "record,file,is_bad,LSOA,Locality,IMD_quintile,Constituency\n1,2,3,a1,l,1,c\n")
    assert readers.read_lookup(spark, other, readers.Quarantine(str(aside))).count() == 1
