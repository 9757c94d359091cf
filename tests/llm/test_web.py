"""Archives, URL trust and tool calls."""

import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toolcalls, urlgraph, warc


def test_archives(spark):
    big = "<p>é" + "x" * 200
    rows = [(1, "http://a/ b", big, 0), (2, None, big, 0), (3, "http://c", None, 0), (4, "http://d", "", 0), (5, "http://e", "small", 0),
            (6, "http://f", "small", 0), (None, "http://g", big, 0), (7, "http://h\r\nX: y", "\r\n\r\nWARC/1.1\r\n\r\n", 0), (1, "http://a", big, 0),
            (8, "http://i", "y" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.archived(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, u, h, _ in rows if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        revisit = r.page_id in (2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == html.encode()
        with open(r.path.removeprefix("file:"), "rb") as file:  # each record is a member of its own
            file.seek(r.offset)
            assert warc.parsed(gzip.GzipFile(fileobj=io.BytesIO(file.read())).read(200_000_000))[0]["warc-type"] == r.record_type
    assert warc.archived(pages.limit(0)).count() == 0


def test_streams_are_cut_into_members(spark, tmp_path):
    rows = warc.decided(spark.createDataFrame([(i, f"http://x/{i}", "t" * i) for i in range(300)], "page_id long, url string, html string"))
    whole = warc.write(rows.coalesce(1), f"{tmp_path}/whole", file_bytes=20_000).collect()
    assert len(whole) > 1 and sum(r.records for r in whole) == 300
    data = open(whole[0].path, "rb").read()
    pieces = list(warc.inflated(io.BytesIO(data), 100))
    assert b"".join(pieces) == gzip.decompress(data) and len(list(warc.records(iter(pieces)))) == whole[0].records
    two = gzip.compress(b"one") + gzip.compress(b"two")
    assert b"".join(warc.inflated(io.BytesIO(two), 5)) == b"onetwo"
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(data[:-20]), 100))
    index = warc.normalise(spark.createDataFrame(whole), f"{tmp_path}/records").collect()
    assert all(sum(1 for _ in open(r["index"])) == r.records for r in index)


URLS = {None: ("", ""), "": ("", ""), "no scheme": ("", ""), "http://A.Org": ("a.org", ""), "x://h/p?q#f": ("h", "/p"), "a://b#c/d": ("b", ""),
        "a://b?x://y": ("b", ""), "http://É.org/É": ("É.org", "/É"), "a://": ("", ""), "a://b://c": ("b:", "//c"), "h\nx://b/c\nd?e": ("b", "/c\nd")}


def test_hosts_and_paths(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", urlgraph.host_of(F.col("url")).alias("h"), urlgraph.path_of(F.col("url")).alias("p"))
    assert {r.url: (r.h, r.p) for r in rows.collect()} == URLS


def test_rules(spark):
    from palimpsest.llm.queries import RULES
    cases = {("a.org", "/x"): "org/", ("org", "/"): "org/", ("org", ""): None, ("xorg", "/"): None, ("m.example.org", "/es/1"): "example.org/es/",
             ("example.org", "/en/12"): "example.org/en/1", ("anexample.org", "/en/1"): "org/", ("b.com", "/fr/"): "com/fr/", ("b.com", "/fr"): None, ("", ""): None}
    rows = spark.createDataFrame(list(cases), "host string, path string").withColumn("r", urlgraph.rule_of(F.col("host"), F.col("path"), RULES))
    assert {(r.host, r.path): r.r.rule if r.r else None for r in rows.collect()} == cases


def test_trust_spreads_over_links(spark):
    def page(i, host, *links, path="/en/9"):
        return i, f"http://{host}{path}", "".join(f"<a href='//{x}/a'>" for x in links), "x"

    rows = [page(1, "good.org", "near.net", "near.net", "shared.net"), page(2, "bad.com", "shared.net", path="/de/1"), page(3, "near.net"),
            page(4, "shady.net", "bad.com"), page(5, "shared.net"), page(6, "alone.net", "alone.net"), (7, None, None, "x"), (8, "nothing", "", "x"),
            page(6, "alone.net", "alone.net")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, trust string")
    rules = [("allow", "good.org", "/"), ("block", "bad.com", "/")]
    got = {r.page_id: r for r in urlgraph.judged(table, rules, hierarchy=False).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert [got[i].rule for i in (1, 2, 3)] == ["good.org/", "bad.com/", None]
    # one step from the trusted seed: two of its three links, and damping
    assert got[3].trust == pytest.approx(0.85 * 0.15 * 2 / 3) and got[3].distrust == 0
    assert got[4].distrust == pytest.approx(0.85 * 0.15) and got[5].trust > 0
    assert len(urlgraph.judged(table, rules).collect()) == len(rows) and urlgraph.judged(table.limit(0), rules).count() == 0


def test_trust_reaches_hosts_far_away(spark):
    chain = [f"h{i}.net" for i in range(25)]
    rows = [(0, "http://good.org/a", "<a href='//h0.net/'>")] + [(i + 1, f"http://{h}/", f"<a href='//{n}/'>") for i, (h, n) in enumerate(zip(chain, [*chain[1:], "bad.com"]))]
    rows += [(50, "http://bad.com/x", ""), (51, "http://c0.com/", "<a href='//c1.com/'>"), (52, "http://c1.com/", "<a href='//c0.com/'><a href='//bad.com/'>")]
    got = {r.page_id: r for r in urlgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), [
        ("allow", "good.org", "/"), ("block", "bad.com", "/")], hierarchy=False).collect()}
    for i in range(25):  # half of the distrust of bad.com goes to the chain, half to c1.com
        trust, distrust = 0.15 * 0.85 ** (i + 1), 0.075 * 0.85 ** (25 - i)
        assert got[i + 1].trust == pytest.approx(trust) and got[i + 1].distrust == pytest.approx(distrust)
        assert got[i + 1].verdict == ("block" if distrust > trust else "allow")
    # a cycle settles: x = 0.85 y, y = 0.85 (x + 0.15 / 2)
    assert got[52].distrust == pytest.approx(0.85 * 0.15 / 2 / (1 - 0.85 ** 2), rel=1e-5)


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id string, conversation long, turn long, name string, arguments string, parent_id string, level string")


SCHEMAS = [("t", "q", "string", True), ("t", "n", "integer", False), ("t", "z", "array", False), (None, "q", "string", True)]


def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "tool string, parameter string, type string, required boolean")


def results(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conversation long, call_id string, content string, status string")


def test_tool_calls(spark):
    good = '{"z": [1, {"y": null, "a": "é\\n"}], "q": "x", "n": 3}'
    rows = [("a", 1, 0, "t", good, None, "x"), ("b", 1, 2, "t", '{"q": 5, "more": 1}', "a", "x"), ("c", 1, 4, "t", "not json", "b", "x"),
            ("d", 1, 6, "other", "{}", "gone", "x"), ("e", 2, 0, "t", "[1]", "f", "x"), ("f", 2, 1, "t", None, "e", "x"), ("g", 2, 2, "t", '{"q": ""}', "f", "x"),
            (None, 3, 0, "t", "{}", None, "x"), ("a", 1, 9, "t", "{}", "b", "x"), ("h", None, None, None, '{"q": "x"}', None, "x")]
    told = results(spark, [(1, "a", "two"), (1, "a", "one"), (1, "a", None), (1, "b", None), (1, None, "lost"), (1, "zz", "nobody"), (2, "a", "elsewhere"), (None, "h", "y"), (None, "h", "y")])
    every = toolcalls.formatted(calls(spark, rows + rows[:1]), told, schemas(spark)).collect()
    got = {r.call_id: r for r in every if r.status in ("linked", "pending", "cycle")}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "h": 0}
    assert {k: r.status for k, r in got.items()} == {**dict.fromkeys("abh", "linked"), **dict.fromkeys("cd", "pending"), **dict.fromkeys("efg", "cycle")}
    assert {k: list(r.problems) for k, r in got.items()} == {
        "a": [], "b": ["type of q", "unknown more"], "c": ["not an object"], "d": ["unknown tool", "unknown parent"], "e": ["not an object"],
        "f": ["not an object"], "g": [], "h": ["unknown tool"]}
    assert got["a"].valid and not got["b"].valid and [got[k].results for k in "abch"] == [3, 1, 0, 2]
    assert got["a"].message == '{"arguments":{"n":3,"q":"x","z":[1,{"a":"é\\n","y":null}]},"id":"a","name":"t","result":"one"}'
    assert json.loads(got["c"].message) == {"arguments_text": "not json", "id": "c", "name": "t", "parent": "b"}
    rest = sorted((str(r.conversation), str(r.turn), str(r.call_id), r.status, r.results, "; ".join(r.problems), r.message) for r in every if r.status not in ("linked", "pending", "cycle"))
    assert rest == [
        ("1", "9", "a", "duplicate", 0, "missing q", '{"arguments":{},"id":"a","name":"t","parent":"b"}'),
        ("1", "None", "None", "orphan", 1, "unknown call", '{"result":"lost"}'), ("1", "None", "a", "extra", 1, "", '{"id":"a","result":"two"}'),
        ("1", "None", "a", "extra", 1, "", '{"id":"a"}'), ("1", "None", "zz", "orphan", 1, "unknown call", '{"id":"zz","result":"nobody"}'),
        ("2", "None", "a", "orphan", 1, "unknown call", '{"id":"a","result":"elsewhere"}'),
        ("3", "0", "None", "unidentified", 0, "missing q", '{"arguments":{},"name":"t"}')]
    assert toolcalls.formatted(calls(spark, rows).limit(0), told.limit(0), schemas(spark)).count() == 0
    assert toolcalls.formatted(calls(spark, rows).limit(0), told, schemas(spark)).count() == 8


def test_one_identifier_in_every_conversation(spark):
    rows = [("call_1", c, 1, "t", f'{{"q": "{c}"}}', None, "x") for c in range(500)] + [("call_1", 7, 3, "t", '{"q": "again"}', "call_1", "x")]
    got = toolcalls.formatted(calls(spark, rows), results(spark, [(c, "call_1", f"r{c}") for c in range(0, 520, 2)]), schemas(spark)).collect()
    assert sorted((r.status, r.conversation) for r in got) == sorted(
        [("linked" if c % 2 == 0 else "pending", c) for c in range(500)] + [("duplicate", 7)] + [("orphan", c) for c in range(500, 520, 2)])
    assert all(json.loads(r.message)["arguments"]["q"] == str(r.conversation) for r in got if r.status in ("linked", "pending"))


def test_exchanges_keep_every_turn(spark):
    chat = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "one\ntwo"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "user", None),
                                  (2, 1, "user", "w " * 30), (2, 5, "assistant", "late"), (2, 6, None, "?"), (2, 7, "tool", None), (2, 1, "user", "w " * 30)],
                                 "conv_id int, turn int, role string, text string")
    told, answers, context = toolcalls.exchanges(chat)
    got = toolcalls.formatted(told, answers, schemas(spark)).unionByName(context).collect()
    assert sorted((r.conversation, str(r.turn), r.status) for r in got) == [
        (1, "0", "context"), (1, "1", "linked"), (1, "3", "pending"), (1, "None", "extra"), (2, "1", "pending"), (2, "6", "context"), (2, "7", "context"), (2, "None", "orphan")]
    assert json.loads(next(r.message for r in got if (r.conversation, r.turn) == (1, 1)))["arguments"] == {"query": ["one", "two"], "words": 2}


def test_long_chains_take_few_rounds(spark):
    rows = [(f"c{i}", 1, i, "t", "{}", f"c{i - 1}" if i else None, "x") for i in range(300)]
    got = {r.call_id: r.level for r in toolcalls.levels(calls(spark, rows)).collect()}
    assert got == {f"c{i}": i for i in range(300)}


def test_rounds_are_planned_once(spark):
    """A round is no job of its own, and the caller's settings stay."""
    edges = spark.createDataFrame([(f"h{i}.net", f"h{i + 1}.net", 1) for i in range(12)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0.net", 1.0, 0.0), ("h12.net", 0.0, 1.0)], "host string, trust double, distrust double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "")
    try:
        got = {r.host: r for r in urlgraph.propagate(edges, seeds).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got["h12.net"].trust == pytest.approx(0.15 * 0.85 ** 12) and got["h0.net"].distrust == pytest.approx(0.15 * 0.85 ** 12)
    assert len(sc.statusTracker().getJobIdsForGroup("rounds")) < 40
    assert {k: spark.conf.get(k) for k in before} == before
