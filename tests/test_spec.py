import pytest

from candidate_funnel.sources import spec as sp


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("root")
    (folder / "data").mkdir()
    (folder / "data" / "Buchwald_Hartwig.csv").write_text(
        "id,Ligand,Additive,Base,Aryl halide,yield\n1,CC,O,N,CBr,10.5\n2,CC,O,P,CCl,bad\n"
    )
    (folder / "data" / "bh_reaction_1.csv").write_text(
        "Ligand,Additive,Base,Aryl halide,objective\nCC,O,N,CI,3\n"
    )
    (folder / "data" / "shields_dataset.csv").write_text(
        "Solvent_SMILES,Base_SMILES,Ligand_SMILES,Temp_C,Concentration,yield\nCO,N,P,90,0.1,7\n"
    )
    return str(folder)


def test_load_casts_by_the_spec(spark, root):
    df = sp.load(spark, sp.REGISTRY["bh_full"], root)
    assert df.dtypes == [
        ("objective", "double"),
        ("Ligand", "string"),
        ("Additive", "string"),
        ("Base", "string"),
        ("Aryl halide", "string"),
    ]
    assert [r.objective for r in df.collect()] == [10.5, None]
    assert dict(sp.load(spark, sp.REGISTRY["shields"], root).dtypes)["Temp_C"] == "double"


def test_sweep(spark, root):
    df = sp.sweep(spark, root=root)
    assert {r.dataset: r["count"] for r in df.groupBy("dataset").count().collect()} == {
        "bh_full": 2,
        "bh_1": 1,
        "shields": 1,
    }
    assert df.where("dataset = 'bh_1'").first()["Temp_C"] is None
    with pytest.raises(KeyError, match="unknown dataset"):
        sp.sweep(spark, ["nope"], root)


def test_direction(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, None)], "row_id int, objective double")
    low = sp.SourceSpec("x", "x.csv", "y", "min", ())
    high = sp.SourceSpec("x", "x.csv", "y", "max", ())
    assert [r.signed for r in sp.orient(df, low).collect()] == [-5.0, -9.0, None]
    assert [r.row_id for r in sp.best(df, low, 1).collect()] == [1]
    assert [r.row_id for r in sp.best(df, high, 3).collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        sp.SourceSpec("x", "x.csv", "y", "up", ())


def test_restriction(spark):
    df = spark.createDataFrame([(1, [6, 1]), (2, [6, 5]), (3, [])], "id int, elements array<int>")
    assert {r.id for r in sp.restrict(df, "elements", {1, 6}).collect()} == {1, 3}
    assert sp.restrict(df, "elements", None).count() == 3
    long = spark.createDataFrame([(1, 6), (1, 1), (2, 6), (2, 5)], "id int, element int")
    kept = sp.restrict_long(df, long, ["id"], "element", {1, 6})
    assert {r.id for r in kept.collect()} == {1, 3}


def test_compounds(spark, root):
    spec = sp.REGISTRY["bh_full"]
    df = sp.load(spark, sp.SourceSpec(spec.name, spec.path, spec.target, "max", spec.compounds, row_id="id"), root)
    long = sp.compound_long(df, spec)
    assert long.count() == 8
    assert {r.role for r in long.collect()} == set(spec.compounds)
    assert {r.key for r in sp.distinct_compounds(df, spec).collect()} == {"CC", "O", "N", "P", "CBr", "CCl"}
