"""Contracts against the same checks on parsed JSON in Python."""

import json
import random

from pyspark.sql import functions as F

from tracewell.functions import payloads
from tracewell.functions.payloads import Field

CONTRACT = (
    Field("id", "integer", ("key", "no"), required=True, low=1, high=9), Field("title", "text", ("name",), required=True), Field("level", "text", default="low", allowed=("low", "high")),
    Field("score", "number", low=0, high=1), Field("tags", "texts", default=("none",)), Field("ok", "flag"), Field("parts", "items"), Field("more", "object"),
)
TYPES = {"integer": int, "text": str, "texts": list, "flag": bool, "items": list, "object": dict}


def plain(text):
    """(reasons, repairs, values) by Python's own parser."""
    try:
        value = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (TypeError, ValueError, ZeroDivisionError):
        return ["broken"], [], None
    if not isinstance(value, dict):
        return ["shape"], [], None
    reasons, repairs, values = [], [], {}
    for f in CONTRACT:
        names = [n for n in (f.name, *f.aliases) if value.get(n) is not None]
        if not names:
            if f.required:
                reasons.append(f"{f.name}:missing")
            values[f.name] = list(f.default) if isinstance(f.default, tuple) else f.default
            if f.default is not None:
                repairs.append(f"{f.name}:default")
            continue
        raw = value[names[0]]
        if names[0] != f.name:
            repairs.append(f"{f.name}:alias")
        right = isinstance(raw, (int, float)) and not isinstance(raw, bool) if f.kind == "number" else isinstance(raw, TYPES[f.kind]) and (f.kind != "integer" or not isinstance(raw, bool))
        values[f.name] = None
        if not right:
            reasons.append(f"{f.name}:type")
            continue
        raw = raw.strip(" \t\r\n") if f.kind == "text" else [x.strip(" \t\r\n") for x in raw if isinstance(x, str) and x.strip(" \t\r\n")] if f.kind == "texts" else raw
        values[f.name] = raw
        if f.kind == "text" and f.required and not raw:
            reasons.append(f"{f.name}:blank")
        elif f.allowed and raw not in f.allowed:
            reasons.append(f"{f.name}:value")
        elif f.low is not None and raw < f.low or f.high is not None and raw > f.high:
            reasons.append(f"{f.name}:range")
    return reasons, repairs, values


def test_contract(spark):
    r = random.Random(91)
    some = [1, 5, 9, 10, 0, -3, 0.5, 1.5, "t", " t ", "", "  ", "low", "high", None, True, [], ["a", " ", None, 3, " b "], {}, {"x": 1}, [1, {"y": None}]]
    names = [n for f in CONTRACT for n in (f.name, *f.aliases)] + ["unknown", "a b"]
    texts = [json.dumps({n: r.choice(some) for n in r.sample(names, r.randint(0, 9))}) for _ in range(400)]
    texts += ['{"id": 3, "title": "x"}', None, "", " ", "{", '{"id": 1},', '{"id": 1} x', '{"id": 1}]', '{"id": 1}}', '{"id": 1}, {"id": 2}', '1, "v": 2', "[]", "null", "3", '"t"', "[{}]", "{'id': 1}", '{"id": 1,}', '{"id": NaN}', '{"id": 3, "title": "' + "y" * 50_000 + '"}']
    rows = spark.createDataFrame([(i, t, "was", "here") for i, t in enumerate(texts)], "n int, text string, fields string, reasons string")
    got = payloads.checked(rows, "text", CONTRACT)
    assert got.columns == ["n", "text", "fields", "reasons", "repairs"]
    held = got.select("n", "reasons", "repairs", "fields.id", "fields.title", "fields.level", "fields.score", "fields.tags", "fields.ok", F.transform("fields.parts", lambda v: F.to_json(v)).alias("parts"), F.to_json("fields.more").alias("more")).collect()
    for x in held:
        reasons, repairs, values = plain(texts[x.n])
        assert (list(x.reasons), list(x.repairs)) == (reasons, repairs), texts[x.n]
        if values:
            assert [x.id, x.title, x.level, x.score, x.tags, x.ok] == [values[n] for n in ("id", "title", "level", "score", "tags", "ok")]
            assert (None if x.parts is None else [json.loads(p) for p in x.parts]) == values["parts"] and (None if x.more is None else json.loads(x.more)) == values["more"]
    assert payloads.accepted(got).count() + payloads.quarantined(got).count() == len(texts) and payloads.accepted(got).count() >= 2
    assert payloads.checked(rows.where("false"), "text", CONTRACT).count() == 0


def test_items(spark):
    rows = spark.createDataFrame([(1, '{"parts": [{"id": 1}, 2, null]}', 7), (2, '{"list": [3]}', 7), (3, '{"parts": {}}', 7), (4, "[", 7), (5, None, 7)], "n int, text string, place int")
    got = payloads.items(rows, "text", "parts", "list")
    assert sorted((x.n, x.place, x.t) for x in got.select("n", "place", F.to_json("item").alias("t")).collect()) == [(1, 0, '{"id":1}'), (1, 1, "2"), (1, 2, "null"), (2, 0, "3")]
    judged = {(x.n, x.place): list(x.reasons) for x in payloads.checked(got, "item", (Field("id", "integer", required=True),)).collect()}
    assert judged == {(1, 0): [], (1, 1): ["shape"], (1, 2): ["shape"], (2, 0): ["shape"]}


def test_proofs(spark):
    whole = {"title": "t", "request": "POST /a HTTP/1.1\nHost: h\n\nx", "response": "HTTP/2 200\n", "payload": "p"}
    cases = [(whole, True), (whole | {"request": "curl http://h", "response": "ok"}, True), (whole | {"note": "TODO"}, False), (whole | {"payload": "..."}, False), (whole | {"title": " "}, False), (whole | {"response": "200"}, False)]
    cases += [(whole | {"request": "POST /a HTTP/1.1"}, False), (whole | {"request": "please post"}, False), ({}, False), ([whole], False), (None, False), ("x", False), (whole | {"payload": 5}, True)]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{"), (98, None)], "n int, text string")
    got = {x.n: x.full for x in rows.select("n", payloads.complete_proof(payloads.parsed(F.col("text"))).alias("full")).collect()}
    assert got == {i: full for i, (_, full) in enumerate(cases)} | {99: False, 98: False}


def test_each_text_is_parsed_twice_and_each_type_read_once(spark):
    rows = spark.createDataFrame([(1, '{"parts": [{"id": 1}]}')], "n int, text string").repartition(2)
    got = payloads.checked(payloads.items(rows, "text", "parts", "list"), "item", CONTRACT)
    plan = got.groupBy("n").agg(F.count_if(F.size("reasons") == 0), F.collect_set(F.array_join("reasons", ",")), F.collect_set(F.array_join("repairs", ",")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") <= 2 and plan.count("schemaOfVariant(") <= len(CONTRACT) + 2, plan
    assert [x.item for x in got.select(F.to_json("item").alias("item")).collect()] == ['{"id":1}']
