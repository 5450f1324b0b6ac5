import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.errors import InvalidInput, PolicyBlocked
from millrace.operators import labels
from millrace.operators.code_step import code_step, map_batches
from millrace.operators.profile import profile
from millrace.plans import build as builds
from millrace.plans import recipes
from millrace.sources import files, jdbc, versions

ORDERS = """order_id,amount,order_date,region,active
1,12.50,2024-01-15,NL,true
2,99.95,2024-01-16,BE,false
3,7.25,2024-01-17,NL,true
4,,2024-01-18,DE,true
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("files"))


@pytest.fixture(scope="module")
def csv(folder):
    path = f"{folder}/orders.csv"
    with open(path, "w") as f:
        f.write(ORDERS)
    return path


def test_infer_csv(spark, csv):
    got = files.infer(spark, csv)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [
        ("order_id", "bigint"), ("amount", "double"), ("order_date", "date"), ("region", "string"), ("active", "boolean")]
    assert got.format == "csv" and got.preview[0]["order_date"] == "2024-01-15" and got.preview[3]["amount"] is None


def test_header_is_found(spark, folder):
    path = f"{folder}/plain.csv"
    with open(path, "w") as f:
        f.write("1,a\n2,b\n")
    assert files.read_csv(spark, path).count() == 2


def test_profile_golden(spark, csv):
    out = {r["name"]: r for r in profile(files.read_csv(spark, csv)).collect()}
    amount, region = out["amount"], out["region"]
    assert (amount["row_count"], amount["null_count"], amount["min"], amount["max"]) == (4, 1, "7.25", "99.95")
    assert [tuple(v) for v in region["top_values"]] == [("NL", 2), ("BE", 1), ("DE", 1)]
    assert out["order_date"]["min"] == "2024-01-15" and out["order_date"]["mean"] is None
    assert out["active"]["kind"] == "other" and out["order_id"]["distinct_approx"] == 4


def test_profile_other_types(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1) AS a, named_struct('x', 1) AS s, INTERVAL 1 DAY AS i, cast(NULL AS string) AS t")
    out = {r["name"]: r for r in profile(df).collect()}
    assert out["s"]["kind"] == "other" and out["m"]["distinct_approx"] is None and out["t"]["null_count"] == 1 and not out["t"]["top_values"]


def test_convert_and_validate(spark, csv, folder):
    schema, rows = files.convert(spark, csv, f"{folder}/orders.parquet")
    assert rows == 4 and files.validate(spark, f"{folder}/orders.parquet") == (schema, 4) == files.validate(spark, f"{folder}/orders.parquet", full=True)
    bad = f"{folder}/bad.parquet"
    with open(bad, "w") as f:
        f.write("no parquet here")
    with pytest.raises(InvalidInput):
        files.validate(spark, bad)


@pytest.mark.parametrize("name", ["x.txt", "x", "x.csv.gz"])
def test_unknown_extension(spark, name):
    with pytest.raises(InvalidInput):
        files.read_file(spark, name)


def test_object_paths():
    assert files.object_path("b", "raw/x.parquet") == "s3a://b/raw/x.parquet"
    for bad in ("x.csv", "/x.parquet", "../x.parquet", "a/../x.parquet"):
        with pytest.raises(InvalidInput):
            files.object_path("b", bad)


def test_json_values(spark):
    df = spark.sql("SELECT double('nan') AS n, double('inf') AS i, 1.50BD AS d, timestamp_ntz '2024-01-02 03:04:05' AS t, array(1, 2) AS a, named_struct('x', 1) AS s, map('k', 2) AS m")
    assert files.rows_as_json(df, 5) == [
        {"n": None, "i": None, "d": "1.50", "t": "2024-01-02T03:04:05", "a": [1, 2], "s": {"x": 1}, "m": {"k": 2}}]
    assert files.finite(df).select("n", "i").first() == (None, None)


def test_sample_limits(spark):
    assert files.sample_rows(spark.range(5000)).count() == 100 and files.sample_rows(spark.range(5000), 1000).count() == 1000
    for limit in (9999, 0, -3):
        with pytest.raises(InvalidInput):
            files.sample_rows(spark.range(50), limit)


def test_csv_loses_nothing(spark, tmp_path):
    (tmp_path / "quoted.csv").write_text('id,note\n1,"a, ""b"" \nc"\n2,plain\n')
    rows = files.read_csv(spark, str(tmp_path / "quoted.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 'a, "b" \nc'), (2, "plain")]
    (tmp_path / "dates.csv").write_text("2024-01-15,x\n2024-01-16,y\n")
    assert files.read_csv(spark, str(tmp_path / "dates.csv")).count() == 2
    for ragged in ("a,b\n1,x,3\n2,y\n", "a,b\n1\n2,y\n"):
        (tmp_path / "ragged.csv").write_text(ragged)
        with pytest.raises(Exception):
            files.read_csv(spark, str(tmp_path / "ragged.csv")).collect()


def workbook(path, rows, styles=""):
    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, tuple):  # (day number, style)
            return f'<c s="{v[1]}"><v>{v[0]}</v></c>'
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        book.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def test_workbook(spark, folder):
    path = f"{folder}/orders.xlsx"
    workbook(path, [["order_id", "region", "order_date", "price", "ok"], [1, "NL", (45306, 1), 1.5, True], [2, "BE", (45307, 1), 2, None]])
    df = files.read_file(spark, path)
    assert df.dtypes == [("order_id", "bigint"), ("region", "string"), ("order_date", "date"), ("price", "double"), ("ok", "boolean")]
    assert [tuple(map(str, r)) for r in df.orderBy("order_id").collect()] == [
        ("1", "NL", "2024-01-15", "1.5", "True"), ("2", "BE", "2024-01-16", "2.0", "None")]


def test_first_sheet_is_the_one_listed_first(spark, folder):
    path, ns = f"{folder}/two.xlsx", 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        for n in (1, 2):
            book.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>from_{n}</t></is></c></row><row><c><v>{n}</v></c></row></sheetData></worksheet>')
        book.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Chart" sheetId="9" r:id="rId9"/><sheet name="Moved" sheetId="2" r:id="rId7"/><sheet name="Old" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      f'<Relationship Id="rId1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Type="{kind}/chartsheet" Target="chartsheets/sheet1.xml"/>'
                      f'<Relationship Id="rId7" Type="{kind}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
    assert files.read_file(spark, path).columns == ["from_2"]


@pytest.mark.parametrize("config", ['{"a": 1.0}', '{"b": 1e20, "a": 1e-7}', '{"a": 123456789012345678901234567890}', '{"x": "1.5é", "y": [0.1, -0.0, 2]}', '{"b": 2, "a": {"d": null, "c": true}}', '{"a": 1E5, "t": "NaN"}', "[]"])
def test_hashes_of_a_column_and_of_one_config_agree(spark, config):
    row = spark.createDataFrame([(config,), (None,)], "c string").select(recipes.config_hashes(F.col("c")).alias("h")).collect()
    assert [r.h for r in row] == [recipes.config_hash(json.loads(config)), None]


@pytest.mark.parametrize("limit", [0, 1001, 5000])
def test_preview_limits_raise(spark, limit):
    with pytest.raises(InvalidInput):
        recipes.preview("sample", {"method": "head"}, [spark.range(3)], limit)


def test_jdbc_names():
    assert jdbc.quoted("public", 'a"b') == '"public"."a""b"'
    with pytest.raises(InvalidInput):
        jdbc.quoted("", "t")


def test_estimate_is_best_effort(spark):
    assert jdbc.row_estimate(spark, jdbc.Database("jdbc:postgresql://none/x", "u", "p"), "public", "t") is None


def test_snapshot_cap(spark, folder):
    assert jdbc.snapshot(spark.range(50), f"{folder}/snap", limit=7) == 7 and jdbc.snapshot(spark.range(50), f"{folder}/snap2") == 50


def test_versions_and_orphans(spark, folder):
    root = f"{folder}/store"
    assert versions.current_version(spark, root, "p", "d") == 0
    with pytest.raises(InvalidInput):
        versions.read_version(spark, root, "p", "d")
    assert versions.write_version(spark.range(3), root, "p", "d", "h1") == 1
    spark.range(99).write.parquet(versions.version_path(root, "p", "d", 2))  # a build that died before its commit
    assert [r["version"] for r in versions.orphans(versions.list_files(spark, f"{root}/projects"), versions.versions(spark, root)).collect()] == [2]
    assert versions.write_version(spark.range(5), root, "p", "d", "h2") == 2  # the retry replaces it
    assert versions.read_version(spark, root, "p", "d").count() == 5 and versions.read_version(spark, root, "p", "d", 1).count() == 3
    spark.range(9).write.parquet(versions.version_path(root, "p", "d", 3))
    assert versions.prune_orphans(spark, root) == 0  # it may be a running build's
    assert versions.prune_orphans(spark, root, older_than_hours=0) == 1 and not os.path.exists(versions.version_path(root, "p", "d", 3))
    row = versions.versions(spark, root).filter("version = 2").first()
    assert row["row_count"] == 5 and json.loads(row["profile"])["row_count"] == 5 and row["recipe_config_hash"] == "h2"


def test_one_build_writes_a_version(spark, folder):
    root = f"{folder}/claims"
    claim = versions.version_path(root, "p", "d", 1) + ".claim"
    os.makedirs(os.path.dirname(claim))
    open(claim, "w").close()
    with pytest.raises(InvalidInput):
        versions.write_version(spark.range(3), root, "p", "d")
    os.utime(claim, (0, 0))  # the other build died long ago
    assert versions.write_version(spark.range(3), root, "p", "d") == 1 and not os.path.exists(claim)
    with pytest.raises(Exception, match="broken"):
        versions.write_version(spark.range(3).select(F.raise_error(F.lit("broken"))), root, "p", "d")
    assert versions.write_version(spark.range(4), root, "p", "d") == 2  # a failed write lets go of its claim


def test_builds_keep_label_floors(spark, folder):
    root = f"{folder}/floors"
    versions.write_version(labels.label_columns(spark.createDataFrame([(1, "111222333")], "id int, number string"), {"number": "bsn"}),
                           root, "p", "people", labels={"classification": "bsn", "confidentiality": "intern"})
    versions.write_version(spark.range(3), root, "p", "ids", labels={"bbn": "bbn2"})
    seen = []
    flow = [
        {"recipe": "r1", "kind": "join", "inputs": ["ids", "people"], "output": "both", "config": {"on": [{"left": "id", "right": "id"}]}},
        {"recipe": "r2", "kind": "prepare", "inputs": ["both"], "output": "slim", "config": {"steps": [{"op": "select", "columns": ["id"]}]}},
        {"recipe": "r3", "kind": "python", "inputs": ["slim"], "output": "out", "config": {"function": lambda slim: seen.append(1) or slim}},
        {"recipe": "r4", "kind": "python", "inputs": ["ids"], "output": "free", "config": {"function": lambda ids: ids}},
    ]
    with pytest.raises(PolicyBlocked):
        builds.build(spark, root, "p", flow, ["out"])
    assert not seen and builds.build(spark, root, "p", flow, ["free"]) == {"free": 1}
    rows = {r["dataset"]: (r["classification"], r["bbn"], r["confidentiality"]) for r in versions.versions(spark, root).collect()}
    assert rows["both"] == rows["slim"] == ("bsn", "bbn2", "intern") and rows["free"] == ("none", "bbn2", None)
    assert labels.column_labels(versions.read_version(spark, root, "p", "both").schema) == {"id": "none", "number": "bsn"}
    versions.write_version(spark.range(3), root, "p", "free", labels={"bbn": "bbn3", "classification": "bijzonder"})  # raised by hand
    versions.write_version(spark.range(9), root, "p", "ids", labels={"bbn": "bbn1"})
    assert builds.build(spark, root, "p", flow, ["free"]) == {"free": 3}
    last = versions.versions(spark, root).filter("dataset = 'free' AND version = 3").first()
    assert (last["classification"], last["bbn"]) == ("bijzonder", "bbn3")
    with pytest.raises(PolicyBlocked):
        builds.build(spark, root, "p", flow, ["free"], force=True, labels={"ids": ("none", "bbn3")})


def test_config_hash_is_canonical():
    assert recipes.config_hash({"b": 1, "a": "é"}) == recipes.config_hash({"a": "é", "b": 1}) != recipes.config_hash({"a": "e", "b": 1})
    assert recipes.config_hash({}) == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"


def test_recipe_arity_and_preview(spark):
    a, b = spark.range(100), spark.range(50, 150)
    with pytest.raises(InvalidInput):
        recipes.run("join", {"on": [{"left": "id", "right": "id"}]}, [a])
    with pytest.raises(InvalidInput):
        recipes.run("pivot", {}, [a])
    config = {"kind": "join", "how": "inner", "on": [{"left": "id", "right": "id"}]}
    assert recipes.preview("join", config, [a, b], 10).count() == 10
    # External inputs are cut before the join, so their preview can be empty.
    assert recipes.preview("join", config, [a.orderBy("id"), b.orderBy("id")], 10, external=(0, 1)).count() == 0
    with pytest.raises(InvalidInput):
        recipes.preview("python", {"function": lambda **k: None}, [a])


def test_code_step_gate(spark):
    df = spark.range(3)
    double = lambda rows: map_batches(rows, lambda pdf: pdf.assign(id=pdf["id"] * 2), "id bigint")
    assert sorted(r["id"] for r in code_step({"rows": df}, double).collect()) == [0, 2, 4]
    for label in (("bsn", None), ("bijzonder", None), ("none", "bbn3")):
        with pytest.raises(PolicyBlocked):
            code_step({"rows": df}, double, {"rows": label})
    assert code_step({"rows": df}, double, {"rows": ("persoonsgegevens", "bbn2")}).count() == 3
    with pytest.raises(InvalidInput):
        code_step({"rows": df}, lambda rows: 3)


def test_build_runs_only_what_is_stale(spark, folder):
    root = f"{folder}/flow"
    raw = spark.createDataFrame([(1, 10.0, "NL"), (2, 20.0, "BE"), (3, 30.0, "NL")], "order_id bigint, amount double, region string")
    names = spark.createDataFrame([("NL", "Netherlands"), ("BE", "Belgium")], "region string, country string")
    versions.write_version(raw, root, "p", "raw")
    versions.write_version(names, root, "p", "names")
    flow = [
        {"recipe": "r1", "kind": "prepare", "inputs": ["raw"], "output": "clean", "config": {"steps": [{"op": "formula", "column": "vat", "expression": "amount * 1.21"}]}},
        {"recipe": "r2", "kind": "join", "inputs": ["clean", "names"], "output": "named", "config": {"on": [{"left": "region", "right": "region"}]}},
        {"recipe": "r3", "kind": "group", "inputs": ["named"], "output": "totals", "config": {"by": ["country"], "aggregations": [{"column": "vat", "func": "sum", "as": "vat"}]}},
        {"recipe": "r4", "kind": "split", "inputs": ["clean"], "output": "nl", "config": {"expression": "region = 'NL'"}},
    ]
    assert builds.build(spark, root, "p", flow, ["totals"]) == {"clean": 1, "named": 1, "totals": 1}
    assert sorted((r["country"], round(r["vat"], 2)) for r in versions.read_version(spark, root, "p", "totals").collect()) == [("Belgium", 24.2), ("Netherlands", 48.4)]
    assert builds.steps_for(spark, root, "p", flow, ["totals"]) == []
    assert builds.steps_for(spark, root, "p", flow, ["totals"], force=True) == ["r1", "r2", "r3"]
    flow[1]["config"]["how"] = "left"
    assert builds.steps_for(spark, root, "p", flow, ["totals"]) == ["r2", "r3"]
    assert builds.build(spark, root, "p", flow, ["nl"]) == {"nl": 1, "nl_rest": 1}
    assert versions.read_version(spark, root, "p", "nl_rest").count() == 1
    versions.write_version(raw, root, "p", "raw")
    assert builds.steps_for(spark, root, "p", flow, ["totals"]) == ["r1", "r2", "r3"]
    with pytest.raises(InvalidInput):
        builds.steps_for(spark, root, "p", flow, ["raw"])
