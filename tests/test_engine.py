import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import canonical as C
from ledgerloom.operators import merge as M
from ledgerloom.operators.ledger import build_ledger, extract, source_log
from ledgerloom.plans import projection as J
from ledgerloom.plans import runner
from tests.fixtures import CLAIMS, CONFIG, MIRA, OUTPUT, laid_out

DOCUMENT = "candidate_id string, pos int, type string, path string, timestamp string, trust double, content string"


@pytest.fixture(scope="module")
def mira(spark, tmp_path_factory):
    return runner.run_manifests(spark, laid_out(tmp_path_factory.mktemp("mira"), MIRA))


@pytest.fixture(scope="module")
def record(mira):
    return mira.canonical.first().asDict(recursive=True)


def claims(spark, *documents):
    rows = [("c", i, kind, "p", None, trust, text) for i, (kind, text, trust) in enumerate((*d, None)[:3] for d in documents)]
    return extract(spark.createDataFrame(rows, DOCUMENT))


def test_counts_and_corrupt_source(mira):
    log = {r.pos: (r.type, r.ok, r.claims) for r in mira.source_log.collect()}
    assert [log[i][2] for i in range(7)] == CLAIMS and log[1] == ("ats_json", False, 0) and all(log[i][1] for i in log if i != 1)
    assert mira.ledger_sizes().first().claims == sum(CLAIMS)


def test_winners_and_confidence(record):
    # system.json's trust of 0.95 beats the export's 0.9; a second source that agrees adds 0.12, a third 0.072; each that differs takes 0.08.
    assert record["validation_errors"] == []
    assert (record["full_name"], record["headline"], record["years_experience"]) == ("Mira Holt", "Pipelines and tea", 8.0)
    assert record["location"] == {"city": "Hamburg", "region": "HH", "country": "DE"}
    assert record["field_confidence"] == {
        "full_name": 0.982,
        "headline": 0.99,
        "years_experience": 0.95,
        "location.city": 1.0,
        "location.region": 0.9,
        "location.country": 1.0,
        "links.linkedin": 0.99,
        "links.github": 0.99,
    }


def test_lists_and_records(record):
    assert record["emails"] == ["mira@holt.example", "m.holt@oldpost.example"]
    assert record["phones"] == ["+49305550188"]
    assert record["links"] == {"linkedin": "https://www.linkedin.com/in/miraholt", "github": "https://github.com/mjholt", "portfolio": None, "other": ["https://holt.example/notes"]}
    skills = {s["name"]: s["sources"] for s in record["skills"]}
    assert skills == {"dbt": ["resume"], "Kubernetes": ["recruiter_notes"], "Rust": ["github_api", "resume"], "Scala": ["github_api", "linkedin", "recruiter_notes"], "SQL": ["ats_json", "linkedin", "resume"]}
    # The export's role comes first (trust 0.9) and takes start and summary from the network's; the CV's is the network's second one.
    assert record["experience"] == [
        {"company": "kranich logistics", "title": "Data Engineer", "start": "2019-04", "end": "present", "summary": "Runs the freight lake."},
        {"company": "Uferwerk", "title": "Analyst", "start": "2016-02", "end": "2019-03", "summary": None},
    ]
    assert record["education"] == [{"institution": "TU Hamburg", "degree": "MSc", "field": "Statistics", "end_year": 2015}]


def test_provenance(record):
    fields = [p["field"] for p in record["provenance"]]
    assert fields[:8] == ["full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "links.linkedin", "links.github"]
    assert {"field": "skills:Scala", "source": "github_api", "method": "notes:skill_phrase"} in record["provenance"]
    assert record["provenance"][-1] == {"field": "education", "source": "resume", "method": "resume:education_section"}


def test_permuted_ledger_gives_the_same(mira, record):
    again = C.canonical_records(mira.ledger.orderBy(F.rand(3)).repartition(3)).first().asDict(recursive=True)
    assert all(again[k] == record[k] for k in again)


def test_configured_output(mira):
    text = J.project_json(mira.canonical.drop("validation_errors"), CONFIG).first().output
    assert json.loads(text) == OUTPUT


def test_command_line(spark, tmp_path, capsys):
    manifest = laid_out(tmp_path, MIRA)
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    assert runner.main(["--manifest", manifest, "--config", str(tmp_path / "config.json"), "--out", str(tmp_path / "o.json"), "--explain"], spark) == 0
    assert (tmp_path / "o.json").read_text() == json.dumps(OUTPUT, indent=2) + "\n"
    assert "SKIP" in capsys.readouterr().err
    assert runner.main(["--manifest", str(tmp_path / "none.json")], spark) == 2
    assert runner.main([], spark) == 2
    (tmp_path / "bad.json").write_text(json.dumps({"on_missing": "maybe"}))
    assert runner.main(["--manifest", manifest, "--config", str(tmp_path / "bad.json")], spark) == 2
    (tmp_path / "list.json").write_text("[1]")
    assert runner.main(["--manifest", str(tmp_path / "list.json")], spark) == 2


def test_paths(mira):
    frame, schema = mira.canonical, mira.canonical.schema

    def at(path):
        v = J._from_columns(schema, path)
        return None if v.column is None else frame.select(v.column.alias("v")).first().v

    assert at("emails[0]") == "mira@holt.example" and at("emails[9]") is None and at("phones[-1]") is None
    assert at("skills[].name")[0] == "dbt" and at("location.country") == "DE"
    assert at("experience[0].title") == "Data Engineer" and at("skills[2].sources[1]") == "resume"
    assert at("location.nothing") is None and at("emails.x") is None and at("") is None


def test_policies(spark):
    row = spark.createDataFrame([("a", None, ["x", None], 9.0)], "candidate_id string, headline string, emails array<string>, years double")
    need = {"fields": [{"path": "h", "from": "headline", "required": True}], "include_confidence": False}
    assert J.project(row, need | {"on_missing": "error"}).first().projection_error == "required field 'h' missing (from 'headline')"
    assert J.project(row, need).first().projection_error is None
    with pytest.raises(Exception, match="projection_error"):
        J.strict(J.project(row, need | {"on_missing": "error"})).collect()
    assert json.loads(J.project_json(row, need | {"on_missing": "omit"}).first().output) == {}
    assert "is not of type 'string[]'" in J.project(row, {"fields": [{"path": "emails", "type": "string[]"}]}).first().projection_error
    number = J.project(row, {"fields": [{"path": "years", "type": "string"}, {"path": "deep.id", "from": "candidate_id", "normalize": "nope"}]}).first()
    assert number.years == "9.0" and number.deep.id == "a"
    with pytest.raises(J.ProjectionError):
        J.project(row, {"fields": [{"path": "a", "from": "years"}, {"path": "a.b", "from": "headline"}]})
    assert json.loads(J.project_json(row, {"fields": [{"path": "years"}, {"path": "t", "from": "candidate_id"}]}).first().output) == {"years": 9, "t": "a"}


def test_json_escapes(spark):
    text = 'a"\\\n\t\r\x01é/'
    row = spark.createDataFrame([(text,)], "x string")
    out = J.project_json(row, {"fields": [{"path": "x"}]}).first().output
    assert json.loads(out) == {"x": text} and "\\u0001" in out and "é/" in out


def test_faulty_documents(spark):
    log = source_log(
        claims(spark, ("fax", "x"), ("resume", None), ("github_api", '{"location": ","}'), ("linkedin", '{"profileUrl": 5}'), ("ats_json", "[1]"), ("ats_json", ""), ("recruiter_csv", "name,location\na,\" , \""), (None, "x"), ("recruiter_notes", ""))
    )
    found = [(r.ok, r.claims, r.error) for r in log.orderBy("pos").collect()]
    assert [f[0] for f in found] == [False, False, False, False, True, True, False, False, True]
    assert found[0][2] == "unknown source type 'fax'" and found[1][2] == "read failed: p" and all(f[1] == 0 for f in found)


def test_trust_and_order(spark):
    ledger = build_ledger(claims(spark, ("resume", "Ann Example\nSKILLS\nGo", 0.1), ("fax", "x"), ("recruiter_notes", "skills: Go")))
    got = {(r.source_id, r.field_path): (r.trust, r.src_order) for r in ledger.collect()}
    assert got == {("resume", "full_name"): (0.1, 0), ("resume", "skills"): (0.7, 0), ("recruiter_notes", "skills"): (0.45, 1)}


def test_recency_and_backfill(spark):
    schema = "candidate_id string, field_path string, value_str string, value_num double, value_exp struct<company:string,title:string,start:string,end:string,summary:string>, method string, source_id string, trust double, observed_at string, src_order int, claim_seq int"
    role = lambda start: ("X", None, start, "present", None)
    ledger = spark.createDataFrame(
        [
            ("c", "headline", "old", None, None, "m", "a", 0.5, "2026-06", 0, 0),
            ("c", "headline", "new", None, None, "m", "b", 0.5, "2026", 1, 0),
            ("c", "headline", None, None, None, "m", "d", 0.9, "2027", 2, 0),
            ("d", "headline", None, None, None, "m", "d", 0.9, "2027", 2, 0),
            ("c", "experience", None, None, role(None), "m1", "a", 0.9, "", 0, 1),
            ("c", "experience", None, None, role("2020-01"), "m2", "b", 0.8, "", 1, 1),
        ],
        schema,
    )
    won = {r.candidate_id: r for r in M.resolve_scalars(ledger).collect()}
    assert (won["c"].value_str, won["c"].agreed, won["c"].conflicted) == ("new", 1, 1)
    assert won["d"].value_str is None and won["d"].confidence == 0.0
    merged = M.merge_experience(ledger).first()
    assert merged.records[0].start == "2020-01" and len(merged.records) == 1 and merged.provenance[0].source == "a"


def test_empty_inputs(spark):
    nothing = claims(spark, ("resume", "x")).limit(0)
    assert build_ledger(nothing).count() == 0
    assert C.canonical_records(build_ledger(nothing)).count() == 0
    alone = spark.createDataFrame([("z",)], "candidate_id string")
    row = C.validate(C.canonical_records(build_ledger(nothing), alone)).first()
    assert row.emails == [] and row.overall_confidence == 0.0 and row.validation_errors == []
