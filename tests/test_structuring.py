from __future__ import annotations

import json
import math
import os

import pytest
from conftest import plan_of
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from skyfold import schemas
from skyfold.operators import unnest
from skyfold.operators.light_curves import derive_flux_and_magnitude, light_curves
from skyfold.operators.structuring import candidates, rejects, structure_objects
from skyfold.plans import catalog_jobs, fixtures
from skyfold.sources import catalog
from skyfold.streaming import catalog_stream
from skyfold.streaming.catalog_stream import ingest_stream


def valid(name, **fields):
    return {"schema": "v1", "name": name, "sources": [{"alias": "1", "name": "s"}], **fields}


def observation(**fields):
    return {"source": "1", "time": "53000.5", "magnitude": "18.1", "band": "g'", **fields}


def structured(spark, documents):
    rows = [(stem, text if isinstance(text, str) else json.dumps(text)) for stem, text in documents.items()]
    return structure_objects(spark.createDataFrame(rows, "file_stem STRING, value STRING"))


REJECTED = {
    "not json": ("not json", "invalid"),
    "single quotes": ("{'single quotes': {'schema': 'v1', 'name': 'a', 'sources': []}}", "invalid"),
    "trailing text": ('{"trailing text": {"schema": "v1", "name": "a", "sources": []}} more', "invalid"),
    "second root": ('{"second root": {"schema": "v1", "name": "a", "sources": []}} {"x": 1}', "invalid"),
    "listed roots": ('{"listed roots": {"schema": "v1", "name": "a", "sources": []}}, {"x": 1}', "invalid"),
    "brace too many": ('{"brace too many": {"schema": "v1", "name": "a", "sources": []}}}', "invalid"),
    "cut short": ('{"cut short": {"schema": "v1", "name": "a", "sources": []}', "invalid"),
    "empty": ("", "invalid"),
    "list root": ([{"a": 1}], "invalid"),
    "scalar root": ("5", "invalid"),
    "other key": ({"x": valid("x")}, "schema"),
    "null entry": ({"null entry": None}, "schema"),
    "scalar entry": ({"scalar entry": 5}, "invalid"),
    "no name": ({"no name": {"schema": "v1", "sources": []}}, "invalid"),
    "no schema": ({"no schema": {"name": "a", "sources": []}}, "invalid"),
    "no sources": ({"no sources": {"schema": "v1", "name": "a"}}, "invalid"),
    "null sources": ({"null sources": {"schema": "v1", "name": "a", "sources": None}}, "invalid"),
    "text sources": ({"text sources": {"schema": "v1", "name": "a", "sources": "abc"}}, "invalid"),
    "source without alias": ({"source without alias": valid("a", sources=[{"name": "s"}])}, "invalid"),
    "source alias no number": ({"source alias no number": valid("a", sources=[{"alias": "one"}])}, "invalid"),
    "null list": ({"null list": valid("a", redshift=None)}, "invalid"),
    "datum without source": ({"datum without source": valid("a", host=[{"value": "x"}])}, "invalid"),
    "datum no number": ({"datum no number": valid("a", redshift=[{"source": "1", "value": "far"}])}, "invalid"),
    "datum bad error": ({"datum bad error": valid("a", host=[{"source": "1", "e_value": "x"}])}, "invalid"),
    "datum bad count": ({"datum bad count": valid("a", host=[{"source": "1", "realization": "1.5"}])}, "invalid"),
    "correlation list": ({"correlation list": valid("a", ebv=[{"source": "1", "correlation": [1]}])}, "invalid"),
    "correlation no value": (
        {"correlation no value": valid("a", ebv=[{"source": "1", "correlation": {"quantity": "q"}}])},
        "invalid",
    ),
    "observation without source": ({"observation without source": valid("a", photometry=[{"time": "1"}])}, "invalid"),
    "observation bad magnitude": (
        {"observation bad magnitude": valid("a", photometry=[observation(magnitude="bright")])},
        "invalid",
    ),
    "source alias null": ({"source alias null": valid("a", sources=[{"alias": None}])}, "invalid"),
    "source alias quoted decimal": ({"source alias quoted decimal": valid("a", sources=[{"alias": "5.0"}])}, "invalid"),
    "source alias quoted truth": ({"source alias quoted truth": valid("a", sources=[{"alias": "true"}])}, "invalid"),
    "source alias list": ({"source alias list": valid("a", sources=[{"alias": [5]}])}, "invalid"),
    "source alias infinite": ('{"source alias infinite": {"schema": "v", "name": "a", "sources": [{"alias": 1e400}]}}', "invalid"),
    "observation quoted truth": ({"observation quoted truth": valid("a", photometry=[observation(magnitude="true")])}, "invalid"),
    "observation object": ({"observation object": valid("a", photometry=[observation(magnitude={"a": 1})])}, "invalid"),
    "observation quoted list": ({"observation quoted list": valid("a", photometry=[observation(time='["1", "2"]')])}, "invalid"),
    "observation hex": ({"observation hex": valid("a", photometry=[observation(flux="0x1p3")])}, "invalid"),
    "observation suffix": ({"observation suffix": valid("a", photometry=[observation(flux="1.5d")])}, "invalid"),
    "observation short time": ({"observation short time": valid("a", photometry=[observation(time=["1"])])}, "invalid"),
    "scalar observation": ({"scalar observation": valid("a", photometry=[observation(), 5])}, "invalid"),
    "null observation": ({"null observation": valid("a", photometry=[observation(), None])}, "invalid"),
    "spectrum bad snr": ({"spectrum bad snr": valid("a", spectra=[{"source": "1", "snr": "x"}])}, "invalid"),
}


def test_rejects(spark):
    objects = structured(spark, {stem: text for stem, (text, _) in REJECTED.items()})
    found = {row.file_stem: row.reason for row in rejects(objects).collect()}
    assert found == {stem: reason for stem, (_, reason) in REJECTED.items()}
    assert candidates(objects).count() == 0
    assert unnest.observations(objects).count() == 0


def test_white_space_around_the_document(spark):
    text = ' \n{"a": {"schema": "v1", "name": "a", "sources": []}}\r\n\t '
    assert candidates(structured(spark, {"a": text})).count() == 1


def test_the_last_of_repeated_keys_counts(spark):
    text = """{"a": {"name": "x"}, "a": {"schema": "v1", "name": "first", "name": "last", "sources": [],
        "sources": [{"alias": 5.0, "secondary": "no"}, {"alias": 7e0, "secondary": 0}], "redshift": [{"source": "1", "value": true}]}}"""
    objects = structured(spark, {"a": text})
    assert candidates(objects).first().name == "last"
    assert [(int(r.alias), r.secondary) for r in unnest.sources(objects).orderBy("pos").collect()] == [(5, True), (7, False)]
    assert unnest.quantities(objects).first().value_num == 1.0


def test_every_quantity_list_is_unnested(spark):
    lists = {name: [{"source": "1", "value": "2.5"}] * (i % 3) for i, name in enumerate(schemas.QUANTITIES)}
    rows = unnest.quantities(structured(spark, {"a": {"a": valid("a", **lists)}})).collect()
    found = {(r.quantity, r.pos): (r.value_str, r.value_num) for r in rows}
    assert found == {
        (name, pos): ("2.5", 2.5 if name in schemas.FLOAT_QUANTITIES else None) for name in lists for pos in range(len(lists[name]))
    }


def test_each_table_reads_its_own_list(spark, tmp_path):
    structured(spark, {"a": {"a": valid("a", photometry=[observation()])}}).write.parquet(str(tmp_path / "objects"))
    read = {"sources": "sources", "quantities": "quantities", "observations": "photometry", "spectra": "spectra"}
    tables = catalog_jobs.unnested(spark, str(tmp_path))
    for name, column in read.items():
        scanned = [line for line in plan_of(tables[name]).split("\n") if "ReadSchema" in line]
        assert scanned and all(column in line for line in scanned)
        assert not any(other in line.replace("file_stem", "") for line in scanned for other in set(read.values()) - {column})


def test_only_files_directly_in_the_folder(spark, tmp_path):
    names = ("SN1", "[HP99] 456", "q*", "{a,b}")
    for folder, stems in ((tmp_path / "c [1]", names), (tmp_path / "c [1]" / "x=1", ("deep",))):
        folder.mkdir(parents=True)
        for stem in stems:
            (folder / f"{stem}.json").write_text(json.dumps({stem: valid(stem)}))
    path = str(tmp_path / "c [1]")
    assert sorted(r.file_stem for r in catalog.read_texts(spark, path).collect()) == sorted(names)
    assert sorted(r.file_name for r in catalog.list_files(spark, path).collect()) == sorted(f"{n}.json" for n in names)
    assert catalog.read_text(spark, path, "q*").count() == 1
    ingest_stream(spark, path, str(tmp_path / "objects"), str(tmp_path / "state"), 3)
    assert sorted(r.file_stem for r in spark.read.parquet(str(tmp_path / "objects")).collect()) == sorted(names)
    (tmp_path / "none" / "x=1").mkdir(parents=True)
    assert catalog.read_texts(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(AnalysisException):
        catalog.read_texts(spark, str(tmp_path / "missing"))


def test_streamed_texts_are_not_exchanged(spark):
    batch = spark.createDataFrame([("a", "{}"), ("a", "{}"), ("b", "{}")], "file_stem STRING, value STRING")
    once = catalog_stream._read_once(batch)
    assert sorted(r.file_stem for r in once.collect()) == ["a", "b"]
    exchanges = [line for line in plan_of(once).split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("value" in line for line in exchanges)
    assert "SortMergeJoin" not in plan_of(once)


optional_text = st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"])))
source_records = st.fixed_dictionaries(
    {"alias": st.integers(-(10**38) + 1, 10**38 - 1)},
    optional={
        "secondary": st.one_of(st.none(), st.booleans()),
        **{field: optional_text for field in ("name", "url", "bibcode", "doi", "arxivid", "acknowledgement")},
    },
)


@settings(
    max_examples=10,
    deadline=None,
    derandomize=True,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large],
)
@given(st.lists(source_records, max_size=20))
def test_source_round_trip(spark, records):
    """Any source keeps its values; only the alias is required and the rest defaults to null."""
    objects = structured(spark, {"a": {"a": valid("a", sources=records)}})
    rows = [row.asDict() for row in unnest.sources(objects).orderBy("pos").collect()]
    assert len(rows) == len(records)
    for row, record in zip(rows, records, strict=True):
        assert row["alias"] == record["alias"] and row["source_name"] == record.get("name")
        for field in ("url", "bibcode", "doi", "arxivid", "secondary", "acknowledgement"):
            assert row[field] == record.get(field)


@settings(
    max_examples=10,
    deadline=None,
    derandomize=True,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large],
)
@given(st.lists(st.tuples(st.integers(-(10**300), 10**300), st.booleans()), max_size=20))
def test_integers_of_any_size(spark, numbers):
    """Quoted or not, an integer is accepted whatever its size; beyond 38 digits only its text holds it."""
    records = [{"alias": str(number) if quoted else number} for number, quoted in numbers]
    rows = unnest.sources(structured(spark, {"a": {"a": valid("a", sources=records)}})).orderBy("pos").collect()
    assert [row.alias_digits for row in rows] == [str(number) for number, _ in numbers]
    assert [row.alias for row in rows] == [number if abs(number) < 10**38 else None for number, _ in numbers]


def plain_truth(value):
    return None if value is None else bool(value)


json_values = st.one_of(
    st.none(), st.booleans(), st.integers(-3, 3), st.floats(-2, 2), st.sampled_from(["", "false", "true", "0", "no", " "]),
    st.sampled_from([[], [0], {}, {"a": 0}, 0.0, -0.0, 10**40, 1e-300]),
)


@settings(
    max_examples=10,
    deadline=None,
    derandomize=True,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large],
)
@given(st.lists(json_values, max_size=20))
def test_truth_is_that_of_plain_values(spark, values):
    records = [{"alias": 1, "secondary": value} for value in values]
    rows = unnest.sources(structured(spark, {"a": {"a": valid("a", sources=records)}})).orderBy("pos").collect()
    assert [row.secondary for row in rows] == [plain_truth(value) for value in values]


def number_of(value):
    """What a plain conversion to a number gives, or None where it fails; "fails" is told apart by the caller."""
    if isinstance(value, (list, dict)):
        return None
    try:
        return float(value)
    except ValueError:
        return None


def test_numbers_are_those_of_plain_values(spark):
    values = [
        5, 5.75, -5.75, True, False, "5", " 5 ", "5.75", "1e3", "true", "false", "", "x", "0x10", "5d", "+7", "-0", "1e400", ".5", "5.", "inf",
        [1], {"a": 1}, 0.1, 12345678901234567890123, 1e22, 123456789.123456789, 2**63, -(2**63), 1e-320, "1e-320",
    ]
    documents = {f"f{i}": {f"f{i}": valid("a", photometry=[observation(airmass=v)])} for i, v in enumerate(values)}
    found = {r.file_stem: r.airmass for r in unnest.observations(structured(spark, documents)).collect()}
    expected = {f"f{i}": number_of(v) for i, v in enumerate(values) if number_of(v) is not None}
    assert found == expected
    documents = {f"i{i}": {f"i{i}": valid("a", photometry=[observation(realization=v)])} for i, v in enumerate(values)}
    found = {r.file_stem: r.realization for r in unnest.observations(structured(spark, documents)).collect()}
    expected = {}
    for i, value in enumerate(values):
        try:
            expected[f"i{i}"] = int(value)
        except (TypeError, ValueError, OverflowError):
            continue
    assert found == expected


def test_candidates_and_photometry_presence(spark):
    documents = {
        "absent": valid("absent"),
        "null": valid("null", photometry=None),
        "empty": valid("empty", photometry=[]),
        "some": valid("some", photometry=[observation()], unknown=[1, {"a": 2}]),
    }
    objects = structured(spark, {stem: {stem: content} for stem, content in documents.items()})
    found = {row.name: row.has_photometry for row in candidates(objects).collect()}
    assert found == {"absent": False, "null": False, "empty": True, "some": True}
    assert rejects(objects).count() == 0


def test_observation_coercion(spark):
    photometry = [
        observation(time=53000, zeropoint=2, upperlimit=True, band="g'"),
        observation(time=["53000", "53003"], magnitude=None, flux=2.5, e_flux=" 0.1 ", band="R"),
        observation(magnitude="NaN", band="V", host=False, includeshost="false", airmass="1e1", realization=7),
        {"source": 1},
    ]
    objects = structured(spark, {"a": {"a": valid("a", photometry=photometry)}})
    rows = unnest.observations(objects).orderBy("pos").collect()
    assert [r.time for r in rows] == [53000.0, 53001.5, 53000.5, None]
    assert [r.upperlimit for r in rows] == [True, False, False, False]
    assert rows[1].e_flux == 0.1 and math.isnan(rows[0].e_flux) and math.isnan(rows[3].e_lower_time)
    assert (rows[2].host, rows[2].includeshost, rows[2].airmass, rows[2].realization) == (False, True, 10.0, 7)
    assert rows[3].source == "1" and rows[3].band_raw is None and rows[3].zeropoint is None
    derived = derive_flux_and_magnitude(unnest.observations(objects)).orderBy("pos").collect()
    assert derived[0].flux == pytest.approx(2 * 10 ** (-0.4 * 18.1))
    assert derived[1].magnitude == pytest.approx(-2.5 * math.log10(2.5))
    assert derived[3].flux is None and derived[3].magnitude is None and derived[3].zeropoint == 1
    curves = light_curves(derive_flux_and_magnitude(unnest.observations(objects)), unnest.OBJECT)
    assert [(r.band, r.pos) for r in curves.orderBy("pos").collect()] == [("g_pr", 0), ("R", 1)]


def test_sources_quantities_spectra(spark):
    content = valid(
        "a",
        sources=[{"alias": 3, "name": "n", "secondary": True, "other": 1}, {"alias": "4", "secondary": "yes"}],
        alias=[{"source": "1", "value": "b"}],
        redshift=[
            {"source": "1,2", "value": 0.5, "derived": True, "correlation": {"quantity": "q", "value": "0.25"}},
            {"source": "1", "value": "0.75", "kind": "host"},
        ],
        spectra=[
            {"source": "1", "time": "5", "data": [["1.5", "2"], [3, 4.5, "5"]], "exclude": {"above": "9", "range": [1]}}
        ],
    )
    objects = structured(spark, {"a": {"a": content}})
    sources = unnest.sources(objects).orderBy("pos").collect()
    assert [(r.alias, r.source_name, r.secondary) for r in sources] == [(3, "n", True), (4, None, True)]
    quantities = unnest.quantities(objects).orderBy("quantity", "pos").collect()
    assert [(r.quantity, r.pos, r.value_str, r.value_num) for r in quantities] == [
        ("alias", 0, "b", None),
        ("redshift", 0, "0.5", 0.5),
        ("redshift", 1, "0.75", 0.75),
    ]
    assert quantities[1].derived is True and quantities[2].kind == "host"
    assert quantities[1].correlation.value_num == 0.25 and quantities[2].correlation is None
    spectrum = unnest.spectra(objects).first()
    assert spectrum.data == [["1.5", "2"], ["3", "4.5", "5"]]
    assert (spectrum.exclude.above, spectrum.exclude.below, spectrum.exclude.range) == (9.0, None, ["1"])
    points = unnest.spectrum_points(unnest.spectra(objects)).orderBy("point_pos").collect()
    assert [(r.wavelength, r.flux, r.e_flux) for r in points] == [(1.5, 2.0, None), (3.0, 4.5, 5.0)]


def test_document_is_parsed_once_per_level(spark):
    """A filter on the outcome must not be pushed into the parsing expressions."""
    plan = plan_of(candidates(structured(spark, {"a": {"a": valid("a")}})))
    filters = [line for line in plan.splitlines() if " Filter " in line]
    assert filters and all("from_json" not in line for line in filters)


NAMES = ["SN1", "[HP99] 456", "a+b%20", "x.y", "it's", "é"]


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "catalog"
    (path / "nested").mkdir(parents=True)
    for i, name in enumerate(NAMES):
        photometry = [observation(time=str(53000 + 4 * j), band="R") for j in range(i)]
        (path / f"{name}.json").write_text(json.dumps({name: valid(name, photometry=photometry)}), encoding="utf-8")
    (path / "bad.json").write_text("{")
    (path / "notes.txt").write_text("{}")
    (path / "nested" / "deep.json").write_text("{}")
    return str(path)


def test_files(spark, folder):
    listed = {row.file_name for row in catalog.list_files(spark, folder).collect()}
    assert listed == {f"{name}.json" for name in NAMES} | {"bad.json"}
    objects = structure_objects(catalog.read_texts(spark, folder))
    assert {row.name for row in candidates(objects).collect()} == set(NAMES)
    for name in NAMES:
        assert candidates(structure_objects(catalog.read_text(spark, folder, name))).first().name == name


def test_written_files_read_back(spark, tmp_path):
    texts = spark.createDataFrame([(name, f'{{"{i}":"\\n"}}') for i, name in enumerate(NAMES)], "file_stem STRING, value STRING")
    fixtures.write_object_files(texts, str(tmp_path / "out"))
    assert sorted(catalog.read_texts(spark, str(tmp_path / "out")).collect()) == sorted(texts.collect())


def test_stream_equals_batch(spark, folder, tmp_path):
    objects, checkpoint = str(tmp_path / "objects"), str(tmp_path / "checkpoint")
    ingest_stream(spark, folder, objects, checkpoint, 3)
    streamed = spark.read.parquet(objects)
    sizes = {row.batch_id: row["count"] for row in streamed.groupBy("batch_id").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 1}
    batch = structure_objects(catalog.read_texts(spark, folder))
    assert sorted(streamed.drop("batch_id").collect(), key=str) == sorted(batch.collect(), key=str)
    with open(os.path.join(folder, "late.json"), "w") as file:
        file.write(json.dumps({"late": valid("late")}))
    ingest_stream(spark, folder, objects, checkpoint, 3)
    assert spark.read.parquet(objects).where("batch_id = 3").first().name == "late"


def test_jobs(spark, folder, tmp_path):
    from skyfold.operators.validation import minimum_observations

    tables_path, csv_path = str(tmp_path / "tables"), str(tmp_path / "csv")
    catalog_jobs.ingest(spark, folder, tables_path)
    counts = {name: spark.read.parquet(f"{tables_path}/{name}").count() for name in ("rejects", "observations", "sources")}
    assert counts == {"rejects": 1, "observations": 15, "sources": 6}
    check = minimum_observations({"R only": ("R",)}, 4)
    tables = catalog_jobs.catalog_tables(spark, tables_path)
    valid_names = {r.name for r in check.validate(tables).where("is_valid").collect()}
    assert valid_names == {"it's", "é"}
    check = minimum_observations(min_observations=4, bandsets={"BRI": ("R",), "gri": ("g",), "gri_primed": ("g_pr",)})
    catalog_jobs.select_valid(tables, [check], check, csv_path)
    lines = sorted(row.value for row in spark.read.text(csv_path).distinct().collect())
    assert lines == sorted(["name,BRI,gri,g'r'i'", "it's,True,False,False", "é,True,False,False"])


def test_two_files_with_one_name_stay_apart(spark):
    documents = {stem: {stem: valid("same", photometry=[observation(band="R")] * n)} for stem, n in (("a", 2), ("b", 5))}
    from skyfold.operators.light_curves import band_counts

    curves = light_curves(derive_flux_and_magnitude(unnest.observations(structured(spark, documents))), unnest.OBJECT)
    counts = {(r.file_stem, r.name): r.n_obs for r in band_counts(curves, unnest.OBJECT).collect()}
    assert counts == {("a", "same"): 2, ("b", "same"): 5}
