import json

import pytest

from tabulon.model import Component, Dataset, Structure
from tabulon.session import Session
from tabulon.sources import Workflow, read_bindings, read_csv, read_json, read_parquet, read_structure, write_csv, write_json, write_parquet
from tabulon.sources.sdmx import mappings
from tabulon.streaming import run_batches, run_stream


@pytest.fixture
def ds(spark):
    s = Session(spark)
    return s.bind("d", spark.createDataFrame([("a", 1, 1.5), ("b", 2, None)], "id string, n bigint, v double"), ids=["id"], attributes=["v"])


def test_parquet_keeps_roles(spark, ds, tmp_path):
    write_parquet(ds, str(tmp_path / "p"))
    back = read_parquet(spark, str(tmp_path / "p"))
    assert back.structure == ds.structure and sorted(map(tuple, back.df.collect())) == sorted(map(tuple, ds.df.collect()))


def test_csv(spark, ds, tmp_path):
    write_csv(ds, str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), ds.structure)
    assert back.structure["n"].type == "integer" and back.df.filter("id = 'a'").first()["v"] == 1.5
    assert read_csv(spark, str(tmp_path / "c")).structure["n"].type == "string"


def test_json_in_either_order(spark, ds):
    text = write_json(ds)
    content = json.loads(text)
    turned = json.dumps({"dataPoints": content["data"], "dataStructure": content["structure"]})
    for t in (text, turned):
        back = read_json(spark, t)
        assert back.structure == ds.structure and back.df.count() == 2
    bound = read_bindings(spark, json.dumps({"x": content, "k": 3}))
    assert isinstance(bound["x"], Dataset) and bound["k"] == 3


SDMX = """<m:Structure xmlns:m="m" xmlns:s="s"><s:DataStructures><s:DataStructure id="DSD1"><s:DataStructureComponents>
<s:DimensionList><s:Dimension id="id"><s:LocalRepresentation><s:Enumeration>urn:sdmx:Codelist=X:CL_ID(1.0)</s:Enumeration></s:LocalRepresentation></s:Dimension>
<s:TimeDimension id="t"><s:LocalRepresentation><s:TextFormat textType="ObservationalTimePeriod"/></s:LocalRepresentation></s:TimeDimension></s:DimensionList>
<s:MeasureList><s:Measure id="v"><s:LocalRepresentation><s:TextFormat textType="Integer"/></s:LocalRepresentation></s:Measure></s:MeasureList></s:DataStructureComponents></s:DataStructure></s:DataStructures>
<s:Dataflows><s:Dataflow id="FLOW"><s:Structure>urn:sdmx:DataStructure=X:DSD1(1.0)</s:Structure></s:Dataflow></s:Dataflows>
<s:VtlMappings><s:VtlMapping id="M" alias="src"><s:Dataflow>urn:sdmx:Dataflow=X:FLOW(1.0)</s:Dataflow></s:VtlMapping></s:VtlMappings>
<s:Transformations><s:Transformation isPersistent="false"><s:Expression>src[filter v &gt; 1]</s:Expression><s:Result>tmp</s:Result></s:Transformation>
<s:Transformation isPersistent="true"><s:Expression>check_datapoint(tmp, r all)</s:Expression><s:Result>out</s:Result></s:Transformation></s:Transformations>
<s:Rulesets><s:Ruleset><s:RulesetDefinition>define datapoint ruleset r (variable v) is v &gt; 2 end datapoint ruleset</s:RulesetDefinition></s:Ruleset></s:Rulesets></m:Structure>"""


def test_sdmx(spark):
    found = read_structure(SDMX, "DSD1")
    assert found == Structure([Component("id", "string", "IDENTIFIER"), Component("t", "date", "IDENTIFIER"), Component("v", "integer")]) and found["id"].domain == "CL_ID"
    assert list(mappings(SDMX)) == ["src"]
    work = Workflow(spark, SDMX)
    assert "bool_var" in work.preview()["out"]
    s = Session(spark)
    src = s.bind("src", spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v bigint").selectExpr("id", "timestamp_ntz'2020-01-01' AS t", "v"), ids=["id", "t"])
    out = Workflow(spark, SDMX, {"src": src}).run()
    assert list(out) == ["out"] and sorted(r.bool_var for r in out["out"].df.collect()) == [False, True]


def test_provenance(spark, ds):
    s = Session(spark)
    s.bind("d", ds)
    p = s.provenance("a := d[calc z := n + 1]; b := a[filter z > 1];", "prog")
    assert p.graph() == [("d", "a"), ("a", "b")] and ("d#n", "a#z") in p.variable_graph()
    assert "sdth:producesDataframe <urn:dataset:b>" in p.turtle() and json.loads(p.json_ld())["@graph"]
    assert [x.source for x in p.steps][0].startswith("a := d[calc")


def test_explain(spark, ds):
    s = Session(spark)
    s.bind("d", ds)
    assert "== a" in s.explain("a := d[filter n > 1];") and not s.outputs


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 5)], "id string, n bigint").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id string, n bigint").parquet(str(tmp_path / "in"))
    out = run_stream(Session(spark), "d", stream(), "r := d[filter n > 1][calc m := n * 2];", "r", ids=["id"])
    q = out.df.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable(), q.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("b", 5, 10)]
    seen = []
    q = run_batches(lambda: Session(spark), "d", stream(), "r := d[aggr c := count()];", lambda o, i: seen.append(o["r"].df.first()["c"]), ids=["id"]).start()
    q.processAllAvailable(), q.stop()
    assert sum(seen) == 2


def test_numeric_texts_of_sdmx_are_numbers():
    from tabulon.sources.sdmx import KINDS

    assert KINDS["Numeric"] == KINDS["Double"] == "number" and KINDS["AlphaNumeric"] == "string"


def test_json_of_a_large_dataset_is_an_error(spark):
    from tabulon.errors import InvalidArgument
    from tabulon.model import wrap
    from tabulon.sources.json_dataset import write_json

    ds = wrap(spark.range(5).withColumnRenamed("id", "i"), ids=["i"])
    assert json.loads(write_json(ds, most=5))["data"] == [[0], [1], [2], [3], [4]]
    with pytest.raises(InvalidArgument):
        write_json(ds, most=4)


def test_jdbc_types(spark):
    """A table in a database that lives in the test's process."""
    from tabulon.sources.files import read_jdbc

    url = "jdbc:derby:memory:tabulon;create=true"
    made = spark.sql("SELECT 1L AS i, 'a' AS s, 1.5D AS d, true AS b, DATE '2020-01-02' AS day, TIMESTAMP '2020-01-02 03:04:05' AS at, CAST(2.25 AS DECIMAL(10, 2)) AS m, 7 AS n")
    made.write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    ds = read_jdbc(spark, url, "t", ids=["i"], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert {c.name: c.type for c in ds.structure} == {"i": "integer", "s": "string", "d": "number", "b": "boolean", "day": "date", "at": "date", "m": "number", "n": "integer"}
    assert ds.ids == ["i"] and ds.df.count() == 1
