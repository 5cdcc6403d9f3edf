"""Fetching, service functions and the command line."""

import json

import pytest

from geoloom import cli, fetch, geocode, ingest, remote, server, service
from geoloom.sources.adapters import Context

from .test_sources import CTX, NSW


def test_retrieve(tmp_path):
    folder = str(tmp_path / "raw")

    def get(url):
        if "bad" in url:
            raise OSError("down")
        return url.encode()

    a = fetch.retrieve("k", ["http://bad/?key=s", "http://one"], folder, get=get)
    assert (a.url, a.changed, a.from_cache) == ("http://one", False, False)
    assert fetch.retrieve("k", ["http://two?token=abc"], folder, get=get).changed
    assert "abc" not in json.dumps(fetch.read_manifest(folder))
    stale = fetch.retrieve("k", ["http://three"], folder, validate=lambda d: "odd", get=get)
    assert stale.stale and "odd" in stale.note and open(stale.path).read() == "http://two?token=abc"
    assert fetch.retrieve("k", [], folder, offline=True).from_cache
    with pytest.raises(FileNotFoundError):
        fetch.retrieve("x", [], folder, offline=True)
    with pytest.raises(ConnectionError):
        fetch.retrieve("x", ["http://bad"], folder, get=get)
    assert fetch.read_manifest(str(tmp_path / "none")) == {"version": 1, "entries": {}}
    assert fetch.redact("https://x/?p=sek&key=1", ("sek",)) == "https://x/?p=REDACTED&key=REDACTED"


def test_service_and_cli(spark, tmp_path, capsys):
    raw, data = tmp_path / "n.csv", f"file://{tmp_path}/data"
    raw.write_text(NSW, encoding="utf-8")
    assert cli.main(["--data", data, "search", "x"], spark) == 3
    assert cli.main(["--data", data, "ingest", f"nsw=file://{raw}", "--as-of", "2026-09-05"], spark) == 0
    assert cli.main(["--data", data, "drift", f"nsw=file://{raw}", "--as-of", "2026-09-06"], spark) == 0
    capsys.readouterr()
    assert cli.main(["--data", data, "search", "--near", "-33.77,150.93", "--radius", "5"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["total"] == 1 and got["sites"][0]["operator"] == "BP Pulse" and got["facets"]["state"] == {"NSW": 1}
    assert cli.main(["--data", data, "search", "--sort", "size"], spark) == 1
    assert cli.main(["sources"], spark) == 0 and cli.main(["--data", data, "stats"], spark) == 0
    told = capsys.readouterr().out
    assert told.index("ultra") < told.index("unknown") and "operators:" in told
    assert cli.main(["--data", data, "build", f"file://{tmp_path}/web"], spark) == 0
    assert len(json.loads((tmp_path / "web/sites.json").read_text())["sites"]) == 3
    svc = service.Service(ingest.load(spark, data), {"generated_at": "x", "licence": "y"})
    site = svc.search({})["sites"][0]["id"]
    assert svc.health() == {"ok": True, "sites": 3} and svc.site(site, "2027-01-01")["staleness"]["status"]["stale"] is True
    assert len(svc.nearest(-33.7, 150.9, 2)) == 2 and svc.stats()["sites"] == 3
    for call, status in ((lambda: svc.site("none", "2027-01-01"), 404), (lambda: svc.nearest(None, 1.0), 400), (lambda: service.Service(None, {}).health(), 503), (lambda: svc.search({"limit": "-1"}), 400)):
        with pytest.raises(service.ServiceError) as e:
            call()
        assert e.value.status == status
    assert Context(**CTX).options == {}
    _over_http(svc, site, tmp_path)


def _over_http(svc, site, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    (tmp_path / "web/index.html").write_text("<p>hi</p>")
    (tmp_path / "hidden").write_text("no")
    s = server.serve(svc, "2027-01-01", str(tmp_path / "web"), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def get(path, method="GET"):
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}{path}", method=method)
        try:
            with urllib.request.urlopen(r, timeout=60) as a:
                return a.status, a.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert json.loads(get("/api/health")[1])["sites"] == 3 and json.loads(get("/api/sites?state=NSW&limit=2")[1])["returned"] == 2
        assert json.loads(get(f"/api/sites/{site}")[1])["site"]["id"] == site and len(json.loads(get("/api/nearest?lat=-33.7&lng=150.9&n=2")[1])["sites"]) == 2
        assert json.loads(get("/api/stats")[1])["sites"] == 3 and len(json.loads(get("/api/export/geojson")[1])["features"]) == 3 and get("/api/meta")[0] == 200
        assert get("/")[1] == "<p>hi</p>" and get("/", "HEAD") == (200, "")
        codes = {get(p, m)[0]: json.loads(get(p, m)[1])["error"]["code"] for p, m in (("/api/sites/none", "GET"), ("/api/nearest", "GET"), ("/api/sites", "POST"))}
        assert codes == {404: "NOT_FOUND", 400: "BAD_QUERY", 405: "METHOD_NOT_ALLOWED"}
        assert [get(p)[0] for p in ("/../hidden", "/%2e%2e/hidden", "/api/none", "/api/export/pdf")] == [404, 404, 404, 400]
    finally:
        s.shutdown()
        s.server_close()


def test_remote(tmp_path):
    """Mirrors, checks, a request that follows from another one, a source without its key."""
    asked = []

    def get(url, body, headers):
        asked.append((url, body))
        if url == remote.OSM_MIRRORS[0]:
            return b'{"elements": [], "remark": "timed out"}'
        if url == remote.OSM_MIRRORS[1]:
            return b'{"elements": [{"id": 1}]}'
        if url == remote.NSW_PACKAGE:
            return json.dumps({"result": {"resources": [{"format": "csv", "name": "old, not updated", "url": "u1", "last_modified": "2026-05"}, {"format": "CSV", "name": "n", "url": "http://u2", "created": "2026-02"}, {"format": "PDF", "url": "u3", "last_modified": "2027"}]}}).encode()
        return b"<html>" if url == remote.QLD_FILE else b"a,b\n" if url == "http://u2" else b"[]"

    paths, failed = remote.get_all(["osm", "nsw", "qld", "ocm", "act"], str(tmp_path), get=get)
    assert set(paths) == {"osm", "nsw"} and failed["ocm"] == failed["act"] == "skipped" and "HTML" in failed["qld"]
    assert b"charging_station" in asked[0][1] and paths["nsw"].endswith("nsw-ev.csv") and ("http://u2", None) in asked
    again, missing = remote.get_all(["osm", "nsw", "qld"], str(tmp_path), offline=True, get=get)
    assert again == paths and set(missing) == {"qld"}
    got, _ = remote.get_all(["ocm", "tas"], str(tmp_path), keys={"ocm": "s3cret"}, pages={"tas": "http://tas"}, get=get)
    assert set(got) == {"ocm", "tas"} and "s3cret" not in json.dumps(fetch.read_manifest(str(tmp_path)))
    assert "typeNames=open-data-platform%3Adcav_site" in remote.vic_url() and remote.newest_csv(b"x") == remote.NSW_LAST_KNOWN
    with pytest.raises(ValueError):
        remote.requests("none")


def test_geocode(spark, tmp_path):
    from geoloom.functions import text

    path, asked = str(tmp_path / "raw/geocodes.json"), []

    def get(url, body, headers):
        asked.append(url)
        if "Nowhere" in url:
            return b"[]"
        return b"" if "Broken" in url else b'[{"lat": "-35.2", "lon": "149.1", "display_name": "m", "category": "a", "type": "b"}]'

    places = ["Venue 1 Main Way, Town", "Nowhere", "Broken", "Venue 1 Main Way, Town", ""]
    s = geocode.fill(places, path, "ACT", get=get, pause_s=0)
    assert (s.requested, s.fetched, s.failed, s.total, s.resolved, s.unresolved) == (3, 1, 2, 3, 1, 2) and len(asked) == 3
    again = geocode.fill([*places, "New"], path, "ACT", offline=True, get=get)
    assert (again.from_cache, again.skipped_offline, again.failed) == (3, 1, 2) and len(asked) == 3
    rows = {r.key: r.result for r in geocode.as_frame(spark, geocode.read_cache(path)).collect()}
    assert list(rows) == sorted(rows) and rows["nowhere"] is None and rows["venue 1 main way town"].lat == -35.2
    assert geocode.read_cache(str(tmp_path / "none.json")) == {}
    d = spark.createDataFrame([(p,) for p in [*places, "12a-14 High St  Level 2, Bondi", "a,b,c"]], "a string")
    for r in d.select("a", text.cache_key(d.a).alias("k"), text.query_variants(d.a, text.F.lit("ACT")).alias("v")).collect():
        assert geocode.key_of(r.a) == r.k and geocode.variants(r.a, "ACT") == (r.v or [])


def test_map_state():
    from geoloom.operators import search

    state = {"site": "s", "text": "a b&c", "state": "VIC", "min_power_kw": 50.0, "corroborated": True, "operator": None}
    link = search.to_link(state)
    assert link == "site=s&q=a%20b%26c&state=VIC&minKw=50&corroborated=1"
    back = search.from_link("#" + link)
    assert (back["text"], back["min_power_kw"], back["corroborated"], back["include_planned"], back["operator"]) == ("a b&c", 50.0, True, False, None)
    q = search.from_state(back, 9, (-38, -37, 140, 141))
    assert q.box is None and q.limit is None and q.min_sources == 2 and q.states == ("VIC",)
    assert search.from_state({}, 9, (-38, -37, 140, 141)).box == (-38.0, -37.0, 140.0, 141.0) and search.from_state({}, 5, (-38, -37, 140, 141)).box is None
