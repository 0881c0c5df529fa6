import json
import threading
import urllib.error
import urllib.request

import pytest

from hirameki.operators import generation
from hirameki.review_server import ReviewStore, server


@pytest.fixture()
def site(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, "猫", ["x"], None, 2.5), (1, 6, "犬", [], True, None), (2, 7, "鳥", None, None, 1.0)], "index int, id long, caption string, missing_tokens array<string>, reviewed boolean, lm_ppl double")
    store = ReviewStore(rows, {"info": {"a": 1}, "lm_fluency_scoring": {"source_thresholds": {"0.95": 2.0, "0.99": 3.0}}}, str(tmp_path / "out.json"), 2)
    s = server(store, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", tmp_path / "out.json"
    s.shutdown()


def call(url, data=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data if data is None or isinstance(data, bytes) else json.dumps(data).encode())) as r:
            body = r.read().decode()
            return r.status, json.loads(body) if "json" in r.headers["Content-Type"] else body
    except urllib.error.HTTPError as e:
        body = e.read()
        return e.code, json.loads(body) if body else None


def test_api(site):
    url, output = site
    assert call(url + "/")[0] == 200 and call(url + "/nothing")[0] == 404
    assert call(url + "/api/metadata")[1] == {"total": 3, "page_size": 2, "fields": ["lm_ppl"], "fluency_threshold": 3.0, "semantic_threshold": None}
    page = call(url + "/api/items?sort=lm_ppl&order=desc")[1]
    assert page["total"] == 3 and [x["id"] for x in page["items"]] == [6, 5]
    assert page["items"][1]["missing_tokens"] == ["x"] and page["items"][1]["extra_fields"] == {"lm_ppl": 2.5} and page["items"][0]["extra_fields"] == {}
    assert [x["id"] for x in call(url + "/api/items?missing_only=1")[1]["items"]] == [5]
    assert call(url + "/api/update", {"id": 5, "caption_replaced": "ねこ"}) == (200, {"ok": True})
    assert call(url + "/api/reviewed", {"id": 7, "reviewed": True})[0] == 200
    assert call(url + "/api/update", {"id": 99, "caption_replaced": "x"})[0] == 404
    assert call(url + "/api/update", {"id": 5})[0] == 400 and call(url + "/api/update", b"{")[0] == 400 and call(url + "/api/other", {})[0] == 404
    edited = call(url + "/api/items?edited_only=1")[1]["items"]
    assert [(x["id"], x["caption_replaced"], x["edited"]) for x in edited] == [(5, "ねこ", True)]
    assert [x["id"] for x in call(url + "/api/items?unreviewed_only=1")[1]["items"]] == [5]
    assert call(url + "/api/save", {})[1]["ok"]
    saved = json.loads(output.read_text())
    assert saved["info"] == {"a": 1} and saved["images"] is None and "lm_fluency_scoring" not in saved
    assert [(a["id"], a["caption_replaced"], a["reviewed"]) for a in saved["annotations"]] == [(5, "ねこ", None), (6, None, True), (7, None, True)]


def test_generation(spark):
    rows = spark.createDataFrame([(0, "ab c"), (1, "d")], "index int, text string")
    got = generation.sampled(rows, "text", lambda: lambda texts: [(t + str(k), -float(k)) for t in texts for k in range(2)], 2).collect()
    assert [[(c["text"], c["score"]) for c in r["candidates"]] for r in got] == [[("ab c0", 0.0), ("ab c1", -1.0)], [("d0", 0.0), ("d1", -1.0)]]
    with pytest.raises(ValueError):
        generation.check_sampling(0)
    with pytest.raises(ValueError):
        generation.Grouped(lambda texts: [("a", None)], 2)(["a", "b"])
    from hirameki.providers import LengthScorer

    scored = generation.scored(rows, "text", LengthScorer).orderBy("index").collect()
    assert scored[1]["lm_ppl"] == pytest.approx(2.0) and scored[0]["lm_ppl"] == pytest.approx(6**0.5)
    fluent = generation.fluency(rows.withColumnRenamed("text", "a").selectExpr("index", "a", "'' AS b"), "a", "b", LengthScorer).first()
    assert fluent["lm_target_ppl"] == float("inf") and fluent["lm_delta_ppl"] == float("inf")
    near = generation.meaning(rows.selectExpr("text AS a", "text AS b"), "a", "b", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 0.5).first()
    assert near["semantic_similarity"] == pytest.approx(1.0) and near["semantic_below_threshold"] is False
    assert generation.thresholds(scored_frame(spark), "x", [0.5]).first()["thresholds"] == {"0.5": 2.0}


def scored_frame(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
