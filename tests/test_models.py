import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stratafin.operators import model_calls as M

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Fixed:
    def __init__(self, *answers):
        self.answers = list(answers)

    def ask(self, prompt):
        a = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(a, Exception):
            raise a
        return a


class ByChunk:
    def ask(self, prompt):
        return '{"a":null,"b":"1"}' if prompt.endswith("first!") else 'ok: {"a":2,"b":"3"} bye' if prompt.endswith("second") else "junk"


def docs(spark):
    return spark.createDataFrame([("D", "first!secondthird!", 1), ("E", "", 1), ("F", None, 1)], "doc_id string, text string, reply int")


@pytest.mark.parametrize(("last", "want"), [(False, {"a": "2", "b": "1", "c": None}), (True, {"a": "2", "b": "3", "c": None})])
def test_merge(spark, last, want):
    got = M.extract_keys(docs(spark), ["a", "b", "c"], ByChunk(), size=6, last_wins=last).collect()
    assert {r.name: r.value for r in got} == want and {r.doc_id for r in got} == {"D"}


def test_offline_and_errors(spark):
    df = spark.createDataFrame([(1, "EBITDA выросла до 46,2 и выручка 5")], "doc_id int, text string")
    got = {r.name: r.value for r in M.extract_keys(df, ["EBITDA", "выручка", "capex"]).collect()}
    assert got == {"EBITDA": "46.2", "выручка": "5", "capex": None}
    calls = M.call_model(spark.createDataFrame([(1, "p")], "i int, prompt string"), Fixed(ValueError("no key"))).first()
    assert (calls.ok, calls.reply, calls.error) == (False, None, "no key")


def test_prompt(spark):
    p = spark.range(1).select(M.extraction_prompt(["a", "b"], F.lit("текст"))).first()[0]
    assert p.startswith("Извлеки коэффициенты: a, b\n\nВерни строго JSON") and p.endswith("Текст:\nтекст") and json.dumps({"a": None, "b": None}) in p
    q = spark.range(1).select(M.advice_prompt(F.lit("- m"), F.array(F.lit("w")))).first()[0]
    assert q.endswith("Коэффициенты:\n- m\n\nПредупреждения:\n- w")


def test_fallback_chain():
    slept = []
    chain = M.Fallback([Fixed(M.TooMany()), Fixed(ValueError()), Fixed("yes")], sleep=slept.append)
    assert chain.ask("x") == "yes" and slept == [M.PAUSE] * M.TRIES
    with pytest.raises(RuntimeError):
        M.Fallback([Fixed(ValueError())]).ask("x")


def test_providers(spark):
    assert M.provider_name(" Open_Router ") == "openrouter" and M.provider_name("gemini") == "google"
    with pytest.raises(ValueError):
        M.provider_name("other")

    def broken(key):
        raise OSError

    assert M.first_valid("k", [("a", broken), ("b", lambda k: False), ("c", lambda k: True)]) == "c" and M.first_valid("k", []) is None
    lists = ['{"data":[{"id":"m1"},{"name":"models/m2"},{"id":"m1"}]}', '{"models":[{"model":"X-large"}]}', '{"result":[]}', "junk"]
    df = spark.createDataFrame([(x,) for x in lists], "p string")
    assert [r[0] for r in df.select(M.model_ids(F.col("p"))).collect()] == [["m1", "m2"], ["X-large"], [], None]
    assert df.select(M.filtered_ids(M.model_ids(F.col("p")), "LARGE")).collect()[1][0] == ["X-large"]


def test_http_providers():
    asked = []

    def transport(url, method="GET", headers=None, payload=None, timeout=60):
        asked.append((url, method, headers, payload))
        if "tags" in url:
            return {"models": [{"name": "m:latest"}]}
        if "generateContent" in url:
            return {"candidates": [{"content": {"parts": [{"text": "g"}, {"text": "!"}]}}]}
        if "generate" in url:
            return {"response": "local"}
        return {"choices": [{"message": {"content": "chat"}}]} if payload["model"] != "bad" else {"error": {"message": "no such model"}}

    assert M.provider("Groq", "k", "m", transport=transport).ask("p") == "chat"
    url, method, headers, payload = asked[-1]
    assert method == "POST" and headers["Authorization"] == "Bearer k" and payload == {"model": "m", "temperature": 0.6, "top_p": 0.95, "max_tokens": 4096, "messages": [{"role": "user", "content": "p"}]}
    assert M.provider("open_router", "k", "m", transport=transport).ask("p") == "chat" and asked[-1][3]["max_tokens"] == 300
    assert M.provider("gemini", "k", "m", transport=transport).ask("p") == "g!" and asked[-1][0].endswith("models/m:generateContent")
    with pytest.raises(RuntimeError, match="no such model"):
        M.provider("groq", "k", "bad", transport=transport).ask("p")
    assert M.Local("m", "be brief", transport=transport).ask("p") == "local" and asked[-1][3]["options"] == {"temperature": 0.3}
    with pytest.raises(RuntimeError, match="no model other"):
        M.Local("other", transport=transport).ask("p")


def test_http_json():
    import http.server
    import threading

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            code = int(self.path.rpartition("/")[2])
            body = self.rfile.read(int(self.headers["Content-Length"])) if code == 200 else b"x" * 5000
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/"
    assert M.http_json(at + "200", "post", payload={"ключ": 1}) == {"ключ": 1}
    with pytest.raises(M.TooMany):
        M.http_json(at + "429", "POST", payload={})
    with pytest.raises(RuntimeError) as e:
        M.http_json(at + "500", "POST", payload={})
    assert str(e.value) == f"HTTP 500 calling {at}500. Body: " + "x" * 2000
    server.shutdown()


def test_other_ways_to_cut(spark):
    df = spark.createDataFrame([("D", '{"b": {"x": 1}, "a": "t"}'), ("E", "junk"), ("F", None)], "doc_id string, text string")
    assert [tuple(r) for r in M.value_chunks(df).collect()] == [("D", 0, '{"x":1}'), ("D", 1, "t")]
    blocks = spark.createDataFrame([("D", 2, 0, "c"), ("D", 1, 1, None), ("D", 1, 0, "a")], "doc_id string, page_number int, block_no int, content string")
    assert sorted(map(tuple, M.block_chunks(blocks).collect())) == [("D", 0, "a"), ("D", 1, "c")]
    assert M.joined_contents(blocks).first().text == "a c"
