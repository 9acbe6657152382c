"""Remote sources and look-ups, against a server of the test."""

import collections
import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from chronotopia.operators.text import contents_length
from chronotopia.sources import lookups, remote
from chronotopia.sources.models import BudgetSpent, ServiceError


@pytest.fixture
def server():
    """Three pages of a catalogue, entities, texts; the first request of each busy address is refused."""
    seen, times = collections.Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            at = urllib.parse.urlsplit(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(at.query).items()}
            seen[self.path] += 1
            times.append(time.time())
            status, body = 200, {}
            book = lambda i: {"id": i, "title": f"Book {i}", "authors": [{"name": q.get("search"), "birth_year": 1800, "death_year": None}], "languages": ["en"], "formats": {"text/plain": f"u{i}"}, "download_count": i}
            if at.path.startswith("/busy") and seen[self.path] < 3:
                status = 429
            elif at.path.startswith("/never"):
                status = 429
            elif at.path == "/slow":
                time.sleep(3)
            elif at.path.rstrip("/").endswith("books"):
                page = int(q["page"])
                status, body = (200, {"results": [book(10 * page + k) for k in range(2)], "next": None}) if page <= 2 else (404, {})
            elif "/books/" in at.path:
                body = book(int(at.path.split("/")[-1])) if at.path.split("/")[-1] != "0" else {}
                status = 404 if not body else 200
            elif at.path == "/entities":
                body = {"entities": {i: {"labels": {"en": {"value": f"L{i}"}}, "sitelinks": {"a": 1, "b": 2}} if i != "Q0" else {"missing": ""} for i in q["ids"].split("|")}}
            elif at.path == "/gone":
                status = 500
            data = ("﻿Text é" if at.path.startswith("/text") else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url, s.seen, s.times = f"http://127.0.0.1:{s.server_port}", seen, times
    yield s
    s.shutdown()


def test_catalogue_pages(spark, server):
    remote.register(spark)
    read = spark.read.format("catalogue").option("url", f"{server.url}/books").option("title", "Emma").option("author", "Jane Austen").option("timeout", 5)
    df = read.load()
    assert df.rdd.getNumPartitions() == 3
    got = df.collect()
    assert sorted((r.page, r.position, r.id) for r in got) == [(1, 0, 10), (1, 1, 11), (2, 0, 20), (2, 1, 21)]
    assert got[0].authors[0].name == "Emma Jane Austen" and got[0].formats["text/plain"] == f"u{got[0].id}"
    assert sum(r.page for r in read.option("pages", 1).load().collect()) == 2
    assert [r.title for r in spark.read.format("catalogue").option("url", f"{server.url}/books").option("id", 7).load().collect()] == ["Book 7"]
    with pytest.raises(Exception, match="404"):
        spark.read.format("catalogue").option("url", f"{server.url}/books").option("id", 0).load().collect()


def test_entities_in_batches(spark, server):
    remote.register(spark)
    ids = ",".join(f"Q{i % 120}" for i in range(240))
    df = spark.read.format("entities").option("url", f"{server.url}/entities").option("ids", ids).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert {(r.id, r.label, r.sitelinks) for r in rows} == {(f"Q{i}", f"LQ{i}", 2) for i in range(1, 120)}
    assert max(len(urllib.parse.parse_qs(urllib.parse.urlsplit(p).query)["ids"][0].split("|")) for p in server.seen) == 50


def test_texts_busy_and_broken_services(spark, server):
    remote.register(spark)
    text = spark.read.format("texts").option("urls", f"{server.url}/text/1\n{server.url}/text/2").load()
    assert sorted(r.text for r in text.collect()) == ["Text é"] * 2 and text.rdd.getNumPartitions() == 2
    waits = []
    assert remote.fetch(f"{server.url}/busy", sleep=waits.append) == b"{}" and waits == [10, 20]
    with pytest.raises(ServiceError, match="429"):
        remote.fetch(f"{server.url}/never", sleep=waits.append)
    assert waits[2:] == [10, 20, 40, 60]
    with pytest.raises(ServiceError, match="500"):
        remote.fetch(f"{server.url}/gone")
    with pytest.raises(ServiceError):
        remote.fetch(f"{server.url}/slow", timeout=0.2)
    rows = spark.createDataFrame([(f"{server.url}/text/3",), (f"{server.url}/text/3",), (f"{server.url}/gone",), (None,)], "url string")
    got = {r.url.split("/")[-1]: (r.text, r.status) for r in remote.download(rows).collect()}
    assert got == {"3": ("Text é", 200), "gone": (None, 500)} and server.seen["/text/3"] == 1


def test_slots_of_two_workers_never_lie_closer_than_the_gap():
    now = [100.0]
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    at = []
    for i in (0, 1):
        now[0] = 100.0
        slots = lookups.Slots(100.0, 1.0, i, 2, lambda: now[0], sleep)
        for k in range(5):
            at.append(slots.wait())
            now[0] += 0.3 if k != 2 else 4.1  # a slow answer leaves slots unused
    # A task that is run again takes later slots, not those that have gone by at once.
    now[0] = 120.4
    again = lookups.Slots(100.0, 1.0, 1, 2, lambda: now[0], sleep)
    at += [again.wait(), again.wait()]
    assert at[-2:] == [121.0, 123.0]
    assert min(b - a for a, b in zip(sorted(at), sorted(at)[1:])) >= 1.0


def test_one_pace_and_one_cache_for_a_run(spark, server, tmp_path):
    url, path = server.url, str(tmp_path / "cache")

    def call(key):
        if key["value"] == "odd":
            raise ServiceError(500)
        remote.fetch(f"{url}/text/{key['value']}")
        return [] if key["value"] == "none" else [{"rank": 0, "name": key["value"]}, {"rank": 1, "name": None}]

    keys = spark.createDataFrame([("city", v) for v in ("a", "b", "c", "a", "none", "odd")] + [("city", None)], "level string, value string")
    got = lookups.looked_up(keys.filter("value IS NOT NULL"), call, "rank int, name string", path, gap=0.5).collect()
    assert sorted((r.value, r.rank, r.name) for r in got) == sorted([(v, k, v if k == 0 else None) for v in "abc" for k in (0, 1)])
    calls = [t for t in sorted(server.times)]
    assert len(calls) == 4 and min(b - a for a, b in zip(calls, calls[1:])) > 0.35
    # Known keys, those without an answer too, are not asked again; a failure is.
    seen = sum(server.seen.values())
    again = lookups.looked_up(spark.createDataFrame([("city", v) for v in ("a", "none", "d")], "level string, value string"), call, "rank int, name string", path, gap=0).collect()
    assert sum(server.seen.values()) == seen + 1 and sorted({r.value for r in again}) == ["a", "d"]
    healed = lookups.looked_up(keys.filter("value = 'odd'"), lambda key: [{"rank": 5}], "rank int, name string", path, gap=0).collect()
    assert [(r.rank, r.name) for r in healed] == [(5, None)]


def test_a_budget_for_all_workers(spark, tmp_path):
    keys = spark.range(40).select("id")
    ask = lambda budget: lookups.looked_up(keys, lambda key: [{"paid": 1.0}], "paid double", str(tmp_path / "paid"), gap=0, budget=budget, cost=lambda a: sum(x["paid"] for x in a), workers=3, wave=6)
    with pytest.raises(BudgetSpent):
        ask(10.0)
    assert spark.read.parquet(str(tmp_path / "paid")).count() == 10
    # The next run goes on where the first was stopped.
    assert ask(100.0).count() == 40 and spark.read.parquet(str(tmp_path / "paid")).count() == 40


def test_a_gazetteer_that_is_asked_once(spark, tmp_path):
    places = spark.createDataFrame([("real", "England", None, "London"), ("real", "England", None, "London"), ("fictional", "Oz", None, None), ("real", None, "Kent", None)], "location_type string, country string, region string, city string")
    places = places.selectExpr("*", "cast(null as string) neighborhood", "cast(null as string) street")
    got = lookups.gazetteer(places, lambda key: [{"rank": 0, "display_name": key["value"], "importance": 0.5, "addresstype": key["level"]}], str(tmp_path / "g"), gap=0)
    assert sorted((r.level, r.value, r.rank, r.importance, r.place_city) for r in got.collect()) == [("city", "London", 0, 0.5, None), ("region", "Kent", 0, 0.5, None)]


def test_contents_by_repeated_numbers():
    heads = lambda *numbers, gap=10: [(gap * i, gap * i + 1, str(x), str(x)) for i, x in enumerate(numbers)]
    assert [contents_length(h) for h in ([], heads(1), heads(1, 2, 3), heads(1, 2, 3, 1, 2, 3), heads(1, 1, 1, 1, 1), heads(1, 2, 1, 2, 1, 2, 1, 2), heads(1, 2, 1, 2, gap=1000))] == [0, 0, 0, 3, 2, 4, 0]
    began = time.process_time()
    assert contents_length(heads(*([1] * 20_000 + [2] + [1] * 20_001))) == 10_000 and time.process_time() - began < 5
