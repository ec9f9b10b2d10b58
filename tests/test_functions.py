"""Rule tables for the scalar semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creatorlake.functions import bodies, coerce, tags, times, urls, variants


def evaluate(spark, inputs, build, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {dtype}")
    if dtype == "string":
        df = df.select("i", "x", F.try_parse_json("x").alias("v"))
    rows = df.selectExpr("i", f"{build} AS r").orderBy("i").collect()
    return [r.r for r in rows]


def test_comma_int(spark):
    cases = {"1,234": 1234, "1.2K": 0, "-5": 0, "+5": 0, " 12 ": 0, "12.0": 0, "": 0, "7": 7, "12\n": 0, "٣": 0}
    assert evaluate(spark, list(cases), coerce.comma_int('x')) == list(cases.values())


def test_counter(spark):
    cases = {"-5": -5, "5.0": 5, "5.5": None, "true": 1, '"1,234"': 1234, '"x"': 0, "[]": None}
    assert evaluate(spark, list(cases), coerce.counter('v')) == list(cases.values())


LAX_INT = {
    "12": 12, "5.0": 5, "5.5": None, "true": 1, "false": 0, "null": None, "1e20": None, "1e2": 100,
    '"12"': 12, '" 12 "': 12, '"+5"': 5, '"-5"': -5, '"1_000"': 1000, '"12.0"': 12, '"12.00"': 12,
    '"1,000"': None, '"12.5"': None, '"12."': None, '"1__0"': None, '"_1"': None, '"1_"': None,
    '".0"': None, '""': None, '"+"': None, '"1e3"': None, '"1_000.0"': 1000, '"12.0_0"': None,
    '"\\t5\\n"': 5, '"007"': 7, '"٣"': None, '"9223372036854775808"': None, "{}": None, "[1]": None,
}


def test_lax_int(spark):
    assert evaluate(spark, list(LAX_INT), coerce.lax_int('v')) == list(LAX_INT.values())


def test_truncating_int(spark):
    cases = {"1.9": 1, "-1.9": -1, '"12.0"': None, '"1,234"': None, '" 12 "': 12, "null": None, "true": 1, "{}": None}
    assert evaluate(spark, list(cases), coerce.truncating_int('v')) == list(cases.values())


def test_lax_bool(spark):
    cases = {
        "true": True, "false": False, "1": True, "0": False, "2": None, "1.0": True, "0.5": None,
        '"yes"': True, '"TRUE"': True, '" true"': None, '"1.0"': None, '"off"': False, '"N"': False,
        "null": None, "{}": None,
    }
    assert evaluate(spark, list(cases), coerce.lax_bool('v')) == list(cases.values())


def test_coercions_agree_with_validation_library(spark):
    pydantic = pytest.importorskip("pydantic")
    import json

    def expect(kind, text):
        try:
            return pydantic.TypeAdapter(kind).validate_python(json.loads(text))
        except pydantic.ValidationError:
            return None

    texts = [t for t in LAX_INT if "9223372036854775808" not in t]
    assert evaluate(spark, texts, coerce.lax_int('v')) == [expect(int, t) for t in texts]
    assert evaluate(spark, texts, coerce.lax_bool('v')) == [expect(bool, t) for t in texts]


def test_missing_null_and_wrong_type(spark):
    docs = ['{"a":{"b":5}}', '{"a":{"b":null}}', '{"a":5}', '{"a":null}', "{}", "null", "[]"]
    got = evaluate(spark, docs, f"to_json({variants.safe_get('v', "a.b", "30")})")
    assert got == ["5", "30", "30", "30", "30", "30", "30"]
    got = evaluate(spark, docs, f"to_json({variants.get_or_default('v', "a", "0")})")
    assert got == ['{"b":5}', '{"b":null}', "5", "null", "0", "0", "0"]


def test_emptiness(spark):
    cases = {"null": True, "{}": True, "[]": True, '""': True, "0": True, "0.0": True, "false": True,
             '"0"': False, '{"a":1}': False, "[0]": False, "5": False, "true": False, '"x"': False}
    assert evaluate(spark, list(cases), variants.is_empty('v')) == list(cases.values())


def test_epoch(spark):
    run = dt.datetime(2025, 1, 2, 3, 4, 5)
    cases = {
        "0": dt.datetime(1970, 1, 1), "1690000000": dt.datetime(2023, 7, 22, 4, 26, 40),
        "1.5": dt.datetime(1970, 1, 1, 0, 0, 1, 500000), "true": dt.datetime(1970, 1, 1, 0, 0, 1),
        "-1": dt.datetime(1969, 12, 31, 23, 59, 59), '"1690000000"': run, "null": run, "{}": run,
        "1690000000000": run, "10000000000000000": run, "100000000000000000": None, "1e20": None,
        "99999999999999999999": None, "253402300799": dt.datetime(9999, 12, 31, 23, 59, 59),
    }
    got = evaluate(spark, list(cases), times.epoch_to_timestamp('v', run))
    assert got == list(cases.values())


def test_epoch_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = evaluate(spark, ["1690000000"], times.epoch_to_timestamp('v', "2025-01-01"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2023, 7, 22, 4, 26, 40)]


URLS = {
    "http://a.com": "http://a.com/", "HTTPS://A.Com/X": "https://a.com/X", "ftp://a.com": None, "a.com": None,
    "http://a.com:99999": None, "http://a.com/ b": "http://a.com/%20b", "http://é.com": "http://xn--9ca.com/",
    "http://a.com:80/": "http://a.com/", "http://a.com:443": "http://a.com:443/",
    "https://a.com:443/x": "https://a.com/x", "http://a.com/é😀": "http://a.com/%C3%A9%F0%9F%98%80",
    "http://a.com/a b": "http://a.com/a%20b", "http://u:p@A.com/": "http://u:p@a.com/",
    "http://a@b@c.com/": "http://a%40b@c.com/", "http://a.com?q=1": "http://a.com/?q=1",
    "http://a.com#f": "http://a.com/#f", "http://a.com/a/../b": "http://a.com/b", "http://a.com/./b": "http://a.com/b",
    "http://a.com/..": "http://a.com/", "http://a.com/a/b/..": "http://a.com/a/", "http:a.com": "http://a.com/",
    "http:///a.com": "http://a.com/", "http:\\\\a.com\\x": "http://a.com/x", " http://a.com ": "http://a.com/",
    "http://a.com/\tx": "http://a.com/x", 'http://a.com/<x>"`{}|^': "http://a.com/%3Cx%3E%22%60%7B%7D|^",
    "http://a.com/?q=a b'<>\"`{}|^": "http://a.com/?q=a%20b%27%3C%3E%22`{}|^",
    'http://a.com/#a b<>`"{}|^': "http://a.com/#a%20b%3C%3E%60%22{}|^", "http://": None, "http:///": None,
    "http://a b.com": None, "http://a_b.com": "http://a_b.com/", "http://256.1.1.1": None,
    "http://1.2.3.4/": "http://1.2.3.4/", "http://[::1]/": "http://[::1]/", "http://a.com:": "http://a.com/",
    "http://a.com:0": "http://a.com:0/", "http://a.com:08080/": "http://a.com:8080/", "http://:80/": None,
    "http://a.com/%zz": "http://a.com/%zz", "http://a|b.com": None, "http://a%b.com": None, "": None,
    "http://a.com/a//b": "http://a.com/a//b", "http://localhost": "http://localhost/",
    "http://a.com/" + "x" * 2070: "http://a.com/" + "x" * 2070, "http://a.com/" + "x" * 2071: None,
}


def test_normalize_url(spark):
    got = evaluate(spark, list(URLS), urls.normalize_url('x'))
    assert dict(zip(URLS, got)) == URLS


def test_normalize_url_agrees_with_validation_library(spark):
    pydantic = pytest.importorskip("pydantic")
    adapter = pydantic.TypeAdapter(pydantic.HttpUrl)

    def expect(u):
        try:
            return str(adapter.validate_strings(u))
        except pydantic.ValidationError:
            return None

    inputs = [u for u in URLS if u]
    got = evaluate(spark, inputs, urls.normalize_url('x'))
    assert dict(zip(inputs, got)) == {u: expect(u) for u in inputs}


HOSTS = """example.com EXAMPLE.com ex%61mple.com É.com exämple.com bücher.example 例え.jp 例え。jp пример.рф 127.1 127.0.0.1 0x7f.1 0X7F.1
    017700000001 2130706433 4294967295 4294967296 256.1.1.1 1.2.3.4.5 1.2.3 1.2.3. 1.2.3.4. 1..2 0x 0x.1 1.0x 08.1 a.08 a.1 1.a 0 00 0x0
    255.255.255.255 255.65536 255.65535 1.256.1 99999999999999999999999 0x100000000 0xffffffff 037777777777 040000000000
    [::1] [::] [2001:db8:0:0:0:0:0:1] [2001:DB8::1] [1:0:0:2:0:0:0:3] [1:0:0:2:3:0:0:4] [::ffff:1.2.3.4] [1:2:3:4:5:6:1.2.3.4]
    [1:2:3:4:5:6:7:8] [1:2:3:4:5:6:7::] [::2:3:4:5:6:7:8] [0:2:3:4:5:6:7:8] [1:2:3] [1::2::3] [12345::] [g::] [] [:] [:::] [::1.2.3]
    [::256.1.1.1] [1:2:3:4:5:6:7:1.2.3.4] [0000:0000:0:00::0001] [::1 %31%32%37.1 a%2eb a%20b a%zz %ff %C3%A9.com a%2Fb xn--exmple-cua.com
    xn--a a+b a_b -a- ＡＢＣ.com a\u00adb.com a\u200bb.com a..b .a a. ǆ.com ﬁ.com Å.com 🙂.com ::1""".split()


def test_hosts_agree_with_validation_library(spark):
    import random

    pydantic = pytest.importorskip("pydantic")
    adapter = pydantic.TypeAdapter(pydantic.HttpUrl)
    rng = random.Random(1)
    hosts = list(HOSTS)
    for _ in range(120):
        groups = [rng.choice(["0", "0", "1", "ab", "0db8", "00"]) for _ in range(rng.randint(6, 8))]
        if rng.random() < 0.5:
            at = rng.randrange(len(groups))
            groups[at : at + rng.randint(0, 3)] = [""]
        hosts += [f"[{':'.join(groups)}]", ".".join(rng.choice(["0", "1", "255", "256", "0x1F", "017", "08", "65535", "65536", "16777215", "0x", ""])
                                                    for _ in range(rng.randint(1, 4)))]

    def expect(host):
        try:
            return str(adapter.validate_strings(f"http://{host}/x"))
        except pydantic.ValidationError:
            return None

    got = evaluate(spark, [f"http://{h}/x" for h in hosts], urls.normalize_url('x'))
    assert dict(zip(hosts, got)) == {h: expect(h) for h in hosts}
    # Letters on which versions of the standard differ give no address.
    assert evaluate(spark, ["http://straße.de/", "http://a\u200db.com/"], urls.normalize_url('x')) == [None, None]


def test_built_addresses(spark):
    got = evaluate(spark, ["ann", "@ann"], urls.profile_url('x'))
    assert got == ["https://www.tiktok.com/@ann"] * 2
    got = evaluate(spark, ["ann", "@ann"], urls.video_url('x', "'9'"))
    assert got == ["https://www.tiktok.com/@ann/video/9"] * 2


def test_tags(spark):
    assert evaluate(spark, ["fit", " #fit "], tags.with_hash('x')) == ["#fit", "#fit"]
    assert evaluate(spark, ["#A#b", "#"], tags.without_hash('x')) == ["ab", ""]
    cases = {"a_1": True, "été": False, "": False, "a\n": False, "x" * 100: True, "x" * 101: False, "a b": False}
    assert evaluate(spark, list(cases), tags.is_valid_tag('x')) == list(cases.values())


def test_before_first_false(spark):
    got = spark.sql("select array('a','b','c') v, array(true,false,true) f union all "
                    "select array('a','b','c'), array(true,true,true) union all select array('a'), array(false)")
    rows = got.selectExpr(f"{tags.before_first_false('v', 'f')} AS r").collect()
    assert sorted(r.r for r in rows) == [[], ["a"], ["a", "b", "c"]]


def test_bodies(spark):
    import base64

    from creatorlake.sources.responses import decoded

    cases = [('{"a":1}', False, '{"a":1}'), ("[]", False, "[]"), ('[{"a":2},{"a":3}]', False, '{"a":2}'),
             ("not json", False, '"not json"'), ('"text"', False, '"text"'), ("[null,1]", False, "null"),
             (base64.b64encode('{"a":"é"}'.encode()).decode(), True, '{"a":"é"}'), (None, False, None)]
    df = spark.createDataFrame([(i, b, f) for i, (b, f, _) in enumerate(cases)], "i int, b string, is_base64 boolean")
    rows = decoded(df.selectExpr("i", "CAST(b AS VARIANT) AS body", "is_base64")).selectExpr("i", "to_json(body) AS r").collect()
    assert [r.r for r in sorted(rows)] == [want for _, _, want in cases]


def test_large_response(spark):
    df = spark.createDataFrame([({"content-length": v},) for v in ["1048576", "1048577", "x"]] + [({},)], "h map<string,string>")
    got = [r.r for r in df.selectExpr(f"{bodies.is_large_response('h', 1048576)} AS r").collect()]
    assert got == [False, True, False, False]
