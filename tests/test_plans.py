"""Whole runs: sections and their schemas, stored marts, sinks, readiness, sources."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from lotscope import Tables, Workspace
from lotscope.model import SCHEMAS
from lotscope.operators.marts import MARTS
from lotscope.plans import presentation, refresh, run
from lotscope.plans.sections import SECTIONS, Section, sections
from lotscope.sources import catalog, orders
from lotscope.sources.tables import jdbc_options, read_parquet, write_prepared


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sections_have_the_promised_schemas(spark, ws):
    for name, df in sections(ws).items():
        promised = SECTIONS[name].empty(spark)
        assert df.dtypes == promised.dtypes, name


def test_tables_need_every_table(spark):
    with pytest.raises(ValueError, match="observation"):
        Tables({name: None for name in SCHEMAS if name != "observation"})
    with pytest.raises(AttributeError):
        Tables.of({name: None for name in SCHEMAS}).nothing


def test_stored_marts_equal_computed_ones(spark, ws, tmp_path):
    root = str(tmp_path / "marts")
    first = refresh.refresh_marts(ws, root)
    stored = refresh.with_stored_marts(ws, root)
    assert set(stored.marts) == set(MARTS)
    for name in MARTS:
        if name != "mesh":
            assert rows(stored.mart(name)) == rows(ws.mart(name)), name
    mesh = lambda w: rows(w.mart("mesh").select("id_area", "lot_id", "nb_data", F.size("tab_lb_nom")))
    assert mesh(stored) == mesh(ws)
    for name in ("kpi_totals", "rank_shares", "by_month", "dataset_table"):
        assert rows(SECTIONS[name].build(stored)) == rows(SECTIONS[name].build(ws)), name
    second = refresh.refresh_marts(ws, root)
    assert first != second and refresh.published_version(spark, root) == second


def test_failed_refresh_leaves_the_published_version(spark, ws, tmp_path, monkeypatch):
    root = str(tmp_path / "marts")
    kept = refresh.refresh_marts(ws, root)

    def broken(_):
        raise RuntimeError("no space")

    monkeypatch.setitem(MARTS, "temporal", broken)
    with pytest.raises(RuntimeError):
        refresh.refresh_marts(ws, root)
    assert refresh.published_version(spark, root) == kept


def test_run_writes_everything(spark, ws, tmp_path):
    out = str(tmp_path / "out")
    outcome = run.run_reports(ws, out)
    assert (outcome.reports, outcome.failed_sections, outcome.exit_code) == (4, (), 0)
    totals = spark.read.parquet(f"{out}/kpi_totals")
    assert set(r["fichier"] for r in totals.collect()) == {"toute_la_base", "source_trois", "melange", "vide"}
    summary = {r["report_id"]: r for r in spark.read.parquet(f"{out}/report_summary").collect()}
    assert summary["all"]["nb_obs"] == 1500 and summary["empty"]["nb_obs"] == 0
    assert summary["all"]["show_data_hors_regions"] and not summary["empty"]["show_data_hors_regions"]
    assert all(r["show_eee"] == (r["nb_nouvelles_eee"] > 0) for r in summary.values())
    outside = spark.read.parquet(f"{out}/outside_region").groupBy("report_id").count().collect()
    assert {r[0]: r[1] for r in outside} == {
        k: v["nb_data_hors_regions"] for k, v in summary.items() if v["nb_data_hors_regions"]
    }
    status = spark.read.parquet(f"{out}/section_status")
    assert status.count() == len(SECTIONS) and status.filter("NOT ok").count() == 0
    assert spark.read.schema(SECTIONS["dup_within"].schema).parquet(f"{out}/dup_within").count() == 0


def test_duplicates_export(spark, ws, tmp_path):
    groups = spark.createDataFrame(
        [("all", 1, "é"), ("all", 2, "b"), ("source3", 3, "c")],
        "report_id string, cd_nom int, lb_nom string",
    )
    run.export_duplicates(groups, run.output_names(ws), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["report_id", "cd_nom", "lb_nom", "fichier"]
    assert rows(back) == [
        ("all", "1", "é", "toute_la_base"), ("all", "2", "b", "toute_la_base"), ("source3", "3", "c", "source_trois"),
    ]
    for path in glob.glob(str(tmp_path / "csv" / "*" / "*.csv")):
        assert open(path, "rb").read(5) == b"\xef\xbb\xbfre"


def test_a_failing_section_is_left_empty_and_recorded(spark, ws, tmp_path, monkeypatch):
    out = str(tmp_path / "out")

    def late(w):
        return SECTIONS["kpi_totals"].build(w).select(
            "report_id", F.raise_error(F.lit("broken at run time")).cast("int").alias("an"),
            F.lit(1).cast("bigint").alias("Donnees"),
        )

    def early(w):
        return w.observation.select("no_such_column")

    names = ["kpi_totals", "by_year", "framework_table"]
    monkeypatch.setitem(SECTIONS, "by_year", Section(late, SECTIONS["by_year"].schema))
    monkeypatch.setitem(SECTIONS, "framework_table", Section(early, SECTIONS["framework_table"].schema))
    outcome = run.run_reports(ws, out, only=names)
    assert outcome.failed_sections == ("by_year", "framework_table") and outcome.exit_code == 2
    status = {r["section"]: r["error"] for r in spark.read.parquet(f"{out}/section_status").collect()}
    assert status["kpi_totals"] is None and "broken at run time" in status["by_year"]
    assert spark.read.schema(SECTIONS["by_year"].schema).parquet(f"{out}/by_year").count() == 0
    assert spark.read.parquet(f"{out}/kpi_totals").count() == 4


def test_only_the_reports_that_fail_lack_a_section(spark, ws, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    good = SECTIONS["by_year"]

    def broken_for_two(w):
        bad = F.col("report_id").isin("source3", "mixed")
        return good.build(w).withColumn("an", F.when(bad, F.raise_error(F.lit("bad date")).cast("int")).otherwise(F.col("an")))

    monkeypatch.setitem(SECTIONS, "by_year", Section(broken_for_two, good.schema, good.order))
    outcome = run.run_reports(ws, out, only=["kpi_totals", "by_year"])
    assert outcome.failed_sections == ("by_year",) and outcome.failed_reports == ("mixed", "source3")
    assert (outcome.reports, outcome.exit_code) == (4, 2)
    status = rows(spark.read.parquet(f"{out}/section_status").select("section", "report_id", "ok"))
    assert status == [("by_year", "mixed", False), ("by_year", "source3", False), ("kpi_totals", None, True)]
    kept = spark.read.parquet(f"{out}/by_year").drop("fichier")
    assert rows(kept) == rows(good.build(ws).filter("report_id not in ('source3', 'mixed')")) and kept.count()


def test_stored_sections_keep_their_order(spark, ws, tmp_path):
    out = str(tmp_path / "out")
    run.run_reports(ws, out, only=["rank_shares", "by_month", "geometry_sizes"])
    for name in ("rank_shares", "by_month", "geometry_sizes"):
        section, files = SECTIONS[name], glob.glob(f"{out}/{name}/fichier=*/*.parquet")
        assert files
        for path in files:
            stored = spark.read.parquet(path)
            assert stored.collect() == stored.coalesce(1).sortWithinPartitions("report_id", *section.ordering).collect(), name


def test_sections_are_ordered_by_columns_that_they_have(spark):
    for name, section in SECTIONS.items():
        assert {c.lstrip("-") for c in section.order} <= set(section.empty(spark).columns), name


def test_the_job_end_to_end(spark, ws, tmp_path, monkeypatch):
    from lotscope.plans import job

    tables, out, marts = (str(tmp_path / n) for n in ("tables", "out", "marts"))
    write_prepared(ws.tables, tables)
    few = {n: SECTIONS[n] for n in ("kpi_totals", "by_year")}
    monkeypatch.setattr(job, "run_reports", lambda w, o: run.run_reports(w, o, only=list(few)))
    assert job.main(["--tables", tables, "--out", out, "--marts", marts, "--refresh-marts"]) == 0
    assert spark.read.parquet(f"{out}/kpi_totals").count() == 4
    one = str(tmp_path / "one")
    assert job.main(["--tables", tables, "--out", one, "--only-file", " melange "]) == 0
    assert [r["report_id"] for r in spark.read.parquet(f"{one}/kpi_totals").collect()] == ["mixed"]
    listed = str(tmp_path / "listed")
    assert job.main(["--tables", tables, "--out", listed, "--list-reports"]) == 0
    written = spark.read.parquet(f"{listed}/kpi_totals")
    # Two import descriptions and four sources are flagged; of these sources 3 and 9 have
    # imports only (customers divisible by 4 are even), so their own lots are empty.
    counts = {r["report_id"]: r["nb_obs"] for r in written.collect()}
    assert len(counts) == 6
    assert sorted(k for k, n in counts.items() if n == 0) == ["source:Suivi Éclair 3", "source:Suivi Éclair 9"]
    assert job.main(["--tables", str(tmp_path / "nothing"), "--out", out, "--marts", marts, "--refresh-marts"]) == 1


def test_no_reports_is_a_success(spark, make, tmp_path):
    outcome = run.run_reports(make(), str(tmp_path / "out"))
    assert (outcome.reports, outcome.exit_code) == (0, 0)
    assert not glob.glob(str(tmp_path / "out" / "*"))


def test_output_names_fall_back_on_the_description(spark, make):
    ws = make(
        report=spark.createDataFrame(
            [("a", "Élan [1]", "", ""), ("b", "x", "nom.f", ""), ("c", "y", None, "")],
            "report_id string, desc_source string, nom_fichier string, list_import string",
        )
    )
    assert rows(run.output_names(ws)) == [("a", "Elan_1"), ("b", "nomf"), ("c", "y")]


def test_displayed_tables(spark, ws):
    ranks = presentation.displayed("rank_shares", SECTIONS["rank_shares"].build(ws))
    assert ranks.columns == [
        "report_id", "Rang", "Nb. de données importées", "Part du lot de données", "Répartition totale dans la base",
    ]
    assert all(r[3].endswith("\u00a0%") for r in ranks.collect())
    for name in presentation.HEADINGS:
        presentation.displayed(name, SECTIONS[name].empty(spark))
    groups = presentation.displayed("dup_within", SECTIONS["dup_within"].empty(spark))
    assert len(groups.columns) == 7
    assert "effectif_min" not in presentation.displayed(
        "invasive_summary", SECTIONS["invasive_summary"].empty(spark)
    ).columns


def test_prepared_tables_round_trip_and_push_the_lot_filter(spark, ws, tmp_path):
    root = str(tmp_path / "tables")
    write_prepared(ws.tables, root)
    back = Workspace(read_parquet(spark, root), ws.params)
    assert back.observation.columns[-1] == "lot_id"
    assert rows(SECTIONS["kpi_totals"].build(back)) == rows(SECTIONS["kpi_totals"].build(ws))
    plan = back.observation.filter(F.col("lot_id") == "3_1").select("geom.kind")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lot_id), EqualTo(lot_id,3_1)]" in text
    assert "struct<kind:string>" in text


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "SELECT 1")
    assert plain["dbtable"] == "(SELECT 1) AS q" and "numPartitions" not in plain
    split = jdbc_options("jdbc:x", "SELECT 1", "id", (1, 9), 4)
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("1", "9", "4")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "SELECT 1", "id")


def test_readiness(spark):
    spark.range(1).createOrReplaceTempView("taxref")
    spark.range(1).createOrReplaceTempView("area")
    got = [(r["criticite"], r["nom_objet"], r["statut"]) for r in catalog.readiness(spark).collect()]
    assert len(got) == 16
    assert [c for c, _, _ in got] == sorted((c for c, _, _ in got), key=["Bloquant", "Majeur", "Mineur"].index)
    found = {name for _, name, status in got if status == "OK"}
    assert {"taxref", "area"} <= found and "observation" not in found
    (function,) = catalog.function_readiness(spark).collect()
    assert function["statut"] == "MANQUANT"
    assert (function["schema_objet"], function["origine"]) == ("default", "Core")
    origins = {r["nom_objet"]: r["origine"] for r in catalog.readiness(spark).collect()}
    assert origins["import"] == "Module Import" and origins["mart_rank"] == "Spécifique projet"
    spark.catalog.dropTempView("taxref")
    spark.catalog.dropTempView("area")


def test_no_plan_has_a_nested_loop_or_python(spark, ws):
    for name in SECTIONS:
        plan = SECTIONS[name].build(ws)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan, name


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["report_id", "nb_obs", "nb_jdd", "nb_ca", "nb_taxon", "nb_esp"]
    assert df.count() == 4
    # Of the text queries, which can be taken away, SQL can't express all.
    own = {*entry.ON_WORKSPACE, "safe_file_name"}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["kpi_totals", "dup_across", "outside_region", "invasive_points", "fold_records"])
def test_registered_queries_match_their_sql(spark, name):
    import check

    folder = "/root/testdata/sf0.001"
    assert check.compare(spark, check.connect(folder), folder, name)[0] == ""


def test_settings_of_the_job():
    from lotscope.model import Params
    from lotscope.plans.job import arguments, settings

    given = arguments([
        "--tables", "t", "--out", "o", "--param", "import_source_id=3", "--param", "invasive_lots=3_1, 3_2",
        "--param", "region_pattern=%Bretagne%", "--param", "duplicate_distance_m=2.5",
    ]).param
    assert settings(given) == Params(
        import_source_id=3, invasive_lots=("3_1", "3_2"), region_pattern="%Bretagne%", duplicate_distance_m=2.5
    )
    assert settings([]) == Params()
    with pytest.raises(ValueError):
        settings(["unknown=1"])
