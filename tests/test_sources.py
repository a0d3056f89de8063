from __future__ import annotations

import json

import pytest

from arbiter.errors import DataValidationError
from arbiter.sources import domain, notes, rest, sinks, strict
from arbiter.sources.strict import fingerprints, loads, records


def put(path, text):
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', "[NaN]", "[Infinity]", "[1e400]", "[" * 201 + "]" * 201, "{", '{"a":1} x'])
def test_loose_json_is_refused(text):
    with pytest.raises(DataValidationError):
        loads(text)


def test_json_shapes():
    assert list(records('[{"a":1},{"a":2}]')) == list(records('{"a":1}\n\n{"a":2}\n')) == [{"a": 1}, {"a": 2}]
    assert list(records('{"a":\n1}')) == [{"a": 1}] and list(records("  ")) == [] and loads('"[[["') == "[[["
    with pytest.raises(DataValidationError, match="blank"):
        list(records('{"a":1}\n\n{"a":2}', blank_lines=False))
    with pytest.raises(DataValidationError, match="object"):
        list(records("[1]"))


def test_domain_files(spark, tmp_path):
    d = domain.load_documents(spark, put(tmp_path / "d.json", [{"id": "d", "title": "T", "topics": [" x ", "x", ""], "metadata": {"k": 1}}])).first()
    assert (d.document_id, d.abstract, d.topics, d.required_experts, json.loads(d.metadata)) == ("d", "", ["x"], None, {"k": 1})
    e = domain.load_experts(spark, put(tmp_path / "e.jsonl", '{"id":"e","name":"N","bids":{"d":1},"publications":[{"title":"P","year":2020}]}\n')).first()
    assert (e.capacity, e.seniority, e.bids, e.publications[0].year, e.publications[0].id) == (3, 0.5, {"d": 1.0}, 2020, None)
    assert domain.load_conflicts(spark, None).count() == 0
    assert domain.load_conflicts(spark, put(tmp_path / "c.json", [{"document_id": "d", "expert_id": "e"}])).first().reason == "declared conflict"


@pytest.mark.parametrize("row", [{"title": "T"}, {"id": "d", "title": "T", "x": 1}, {"id": "d", "title": 1}, {"id": "d", "title": "T", "required_experts": True}, {"id": "d", "title": "T", "topics": ["a", 1]}, {"id": "d", "title": "T", "required_experts": 1.0}])
def test_bad_documents_are_refused(spark, tmp_path, row):
    with pytest.raises(DataValidationError):
        domain.load_documents(spark, put(tmp_path / "d.json", [row]))


def test_record_limits_and_encodings(spark, tmp_path):
    rows = [{"id": f"d{i}", "title": "T"} for i in range(3)]
    assert domain.load_documents(spark, put(tmp_path / "d.json", rows), max_records=3).count() == 3
    with pytest.raises(DataValidationError, match="more than 2"):
        domain.load_documents(spark, str(tmp_path / "d.json"), max_records=2)
    (tmp_path / "bad.json").write_bytes(b'[{"id":"\xff","title":"T"}]')
    with pytest.raises(DataValidationError, match="UTF-8"):
        domain.load_documents(spark, str(tmp_path / "bad.json"))


def test_affinity_files(spark, tmp_path):
    want = {("d", "a,b"): 0.5, ("d", "c"): 1.0}
    for k, text in enumerate(('document_id,expert_id,score\nd,"a,b",0.5\n\nd,c,1\n', 'd,"a,b",0.5\r\nd,c,1\r\n')):
        got = domain.load_affinities(spark, put(tmp_path / f"a{k}.csv", text))
        assert {(r.document_id, r.expert_id): r.score for r in got.collect()} == want
    for k, text in enumerate(("d,e,1.5\n", "d,e,x\n", "d,e\n", "d,e,1,2\n", "d,e,1\nd,e,0.5\n", "d,e,nan\n", "document_id,expert_id,score\n", "d,,1\n")):
        with pytest.raises(DataValidationError):
            domain.load_affinities(spark, put(tmp_path / f"b{k}.csv", text))


def test_judgment_files(spark, tmp_path):
    tsv = domain.load_judgments(spark, put(tmp_path / "j.tsv", "document_id\texpert_id\trelevance\nd\te\t2\n"))
    assert list(map(tuple, tsv.collect())) == [("d", "e", 2)]
    head = ",".join(["ParticipantID", *[x for i in range(1, 11) for x in (f"Paper{i}", f"Expertise{i}")]])
    wide = domain.load_judgments(spark, put(tmp_path / "w.csv", f"{head}\np,x,3{',' * 18}\n"))
    assert list(map(tuple, wide.collect())) == [("x", "p", 3)]
    for k, text in enumerate(("d,e,1\n", "document_id,expert_id,relevance\nd,e,1001\n", "document_id,expert_id,relevance\nd,e,-1\n", "document_id,expert_id,relevance\nd,e,1\nd,e,2\n")):
        with pytest.raises(DataValidationError):
            domain.load_judgments(spark, put(tmp_path / f"x{k}.csv", text))


NOTE = {"id": "n", "forum": "f", "content": {"title": {"value": "T"}, "abstract": "A", "keywords": {"value": ["k"]}, "subject_areas": ["s", "t"], "subject_area": {"value": "t"}}}


def test_snapshots(spark, tmp_path):
    s = put(tmp_path / "s.jsonl", json.dumps(NOTE) + "\n")
    p = put(tmp_path / "p.jsonl", "\n".join(json.dumps(x) for x in [{"id": "~A", "content": {"names": [{"fullname": "First"}, {"fullname": "Chosen", "preferred": True}], "expertise": ["x"], "research_interests": {"value": ["x", "y"]}}}, {"id": "~B", "content": {"names": [{"fullname": "Only"}]}}]))
    paper = lambda r, i, t: {"reviewer_id": r, "note": {"id": i, "content": {"title": t, "year": {"value": 2020}}}}
    r = put(tmp_path / "r.jsonl", "\n".join(json.dumps(x) for x in [paper("~A", "2", "B"), paper("~A", "1", "C")]))
    d, e = notes.load_snapshot(spark, s, p, r, capacity=2)
    row = d.first()
    assert (row.title, row.abstract, row.topics, row.keywords) == ("T", "A", ["s", "t"], ["k"]) and json.loads(row.metadata)["openreview_forum"] == "f"
    got = {x.expert_id: x for x in e.collect()}
    assert got["~A"].name == "Chosen" and got["~A"].topics == ["x", "y"] and [x.id for x in got["~A"].publications] == ["1", "2"] and got["~B"].publications == [] and got["~B"].capacity == 2
    for bad in ([paper("~C", "1", "x")], [paper("~A", "1", "x"), paper("~A", "1", "y")], [{"reviewer_id": "~A", "note": {}, "more": 1}]):
        with pytest.raises(DataValidationError):
            notes.load_snapshot(spark, s, p, put(tmp_path / "bad.jsonl", "\n".join(map(json.dumps, bad))))
    ids = notes.load_reviewer_ids(spark, put(tmp_path / "ids.txt", "~A\n\n~B\n"), 5)
    assert {(x.expert_id, x.name, x.capacity) for x in ids.collect()} == {("~A", "~A", 5), ("~B", "~B", 5)}


def test_publication_filters_count_each_reason(spark):
    day = 86_400_000
    rows = [("e", "1", "inv", 20_000 * day, None, None, "T", "A"), ("e", "2", "other", 20_000 * day, None, None, "T", "A"), ("e", "3", "inv", None, None, None, "T", "A"), ("e", "4", "inv", None, 10 * day, None, "T", "A"), ("e", "5", "inv", None, None, 20_000 * day, " ", "A")]
    df = spark.createDataFrame(rows, "expert_id string, note_id string, invitation string, pdate long, odate long, cdate long, title string, abstract string")
    kept, counts = notes.filter_publications(df, ("inv",), minimum_date=100 * day)
    assert {r.reason: r.n for r in counts.collect()} == {"retained": 1, "invitation": 1, "date": 2, "content": 1}
    assert list(map(tuple, kept.collect())) == [("e", "1", "T", "A", 2024)]


class Fake:
    """Answers from a list; keeps what was asked and how long was slept."""

    def __init__(self, *answers):
        self.answers, self.urls, self.slept = list(answers), [], []

    def get(self, url, headers, timeout, max_bytes):
        self.urls.append(url)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a if isinstance(a, rest.Response) else rest.Response(200, {}, json.dumps(a).encode())


def client(fake, **options):
    return rest.Client("https://site.example", fake, page_size=2, sleep=fake.slept.append, clock=lambda: 0.0, **options)


def page(count, *ids):
    return {"count": count, "notes": [{"id": i} for i in ids]}


def test_pages_follow_the_cursor():
    fake = Fake(page(3, "a", "b"), page(3, "c"))
    assert [n["id"] for n in client(fake).notes(invitation="v")] == ["a", "b", "c"] and "after=b" in fake.urls[1] and "after" not in fake.urls[0]


@pytest.mark.parametrize("answers", [(page(3, "a"), page(3)), (page(1, "a", "b"),), (page(2, "b", "a"),), (page(2, "a"), page(2, "a")), ({"notes": []},), ({"count": True, "notes": []},)])
def test_broken_pages_fail(answers):
    with pytest.raises(rest.ProtocolError):
        list(client(Fake(*answers)).notes())


def test_retries_wait_as_asked():
    fake = Fake(rest.Response(429, {"Retry-After": "7"}, b""), rest.Response(503, {}, b""), rest.TransportError("gone"), page(0))
    assert list(client(fake).notes()) == [] and fake.slept == [7.0, 1.0, 2.0]
    date = Fake(rest.Response(503, {"Retry-After": "Thu, 01 Jan 1970 00:10:00 GMT"}, b""), page(0))
    assert list(client(date).notes()) == [] and date.slept == [rest.LONGEST_WAIT]
    with pytest.raises(rest.TransportError):
        list(client(Fake(*[rest.Response(500, {}, b"")] * 4)).notes())
    with pytest.raises(rest.ProtocolError, match="404"):
        list(client(Fake(rest.Response(404, {}, b""))).notes())
    with pytest.raises(rest.TransportError, match="budget"):
        list(client(Fake(page(2, "a"), page(2, "b")), max_requests=1).notes())


def test_groups_profiles_and_origins():
    assert client(Fake({"groups": [{"id": "g", "members": ["~A1", "~B1"]}]})).group_members("g") == ("~A1", "~B1")
    with pytest.raises(rest.ProtocolError):
        client(Fake({"groups": [{"id": "g", "members": ["a@b.c"]}]})).group_members("g")
    got = client(Fake({"profiles": [{"id": "~A", "content": {"names": [], "emails": ["x"], "bio": "b"}}]})).profile("~A")
    assert got == {"id": "~A", "content": {"names": [], "bio": "b"}}
    for url in ("http://x.example", "https://x.example/path", "https://u@x.example"):
        with pytest.raises(DataValidationError):
            rest.Client(url)


def test_run_folders(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    record = sinks.write_run(tmp_path / "run", {"rows.jsonl": sinks.jsonl(rows, "id")}, {"schema_version": 1})
    assert (tmp_path / "run" / "rows.jsonl").read_text() == '{"id":"a","n":1}\n{"id":"b","n":2}\n' and sinks.verify_run(tmp_path / "run") == record
    assert fingerprints(spark, str(tmp_path / "run" / "rows.jsonl")).first().sha256 == record["files"]["rows.jsonl"]["sha256"]
    with pytest.raises(DataValidationError, match="exists"):
        sinks.write_run(tmp_path / "run", {})
    (tmp_path / "run" / "rows.jsonl").write_text("other")
    with pytest.raises(DataValidationError):
        sinks.verify_run(tmp_path / "run")
    sinks.write_json(tmp_path / "x.json", {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(DataValidationError):
        sinks.write_json(tmp_path / "x.json", {}, replace=False)
    with pytest.raises(ValueError):
        sinks.stable_json(float("nan"))
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []


def test_large_line_files_are_read_in_splits(spark, tmp_path):
    """The same rows and places as a whole file gives, by tasks that each hold a part of it."""
    pad = "x" * 400
    lines = [json.dumps({"document_id": f"d{i}", "expert_id": f"é{i}", "reason": pad}, ensure_ascii=False) + ("\r" if i % 5 == 0 else "") for i in range(9000)]
    path = tmp_path / "c"
    path.mkdir()
    (path / "large.jsonl").write_bytes(b"\xef\xbb\xbf" + "\n\n".join(lines).encode())
    (path / "small.json").write_text(json.dumps([{"document_id": "a", "expert_id": "b"}]))
    reader = strict.read_records(spark, str(path), domain.conflict_row, domain.schemas.CONFLICTS)
    assert reader.rdd.getNumPartitions() > 2
    got = {r.document_id: (r.expert_id, r.position) for r in domain.load_conflicts(spark, str(path)).collect()}
    assert got == {"a": ("b", 0)} | {f"d{i}": (f"é{i}", i) for i in range(9000)}
    with pytest.raises(DataValidationError, match="more than 8999"):
        domain.load_conflicts(spark, str(path), max_records=8999)
    with pytest.raises(DataValidationError, match="blank"):
        strict.read_records(spark, str(path), domain.conflict_row, domain.schemas.CONFLICTS, blank_lines=False)
    for bad, said in ((b'{"document_id":"d","expert_id":"\xff"}', "UTF-8"), (b"[1]", "object"), (b'{"document_id":"d","document_id":"d","expert_id":"e"}', "repeats"), (b'{"a":', "not JSON")):
        (path / "large.jsonl").write_bytes("\n".join(lines).encode() + b"\n" + bad)
        with pytest.raises(DataValidationError, match=said):
            domain.load_conflicts(spark, str(path))
    # Large files of other shapes are still read whole.
    (path / "large.jsonl").write_text(json.dumps([json.loads(x) for x in lines], indent=1))
    assert domain.load_conflicts(spark, str(path)).count() == 9001
