"""Scalar vectors."""

from pyspark.sql import functions as F

from feedlake import functions as fn


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def test_decimals(spark):
    cases = {
        "21921.73": (2192173, 2), "0.06317902": (6317902, 8), "21922.10": (2192210, 2), "100": (100, 0), "0": (0, 0),
        "-0.5": (-5, 1), "123456789.12345678": (12345678912345678, 8), "922337203685477580.7": (2**63 - 1, 1),
        ".5": (5, 1), "5.": (5, 0), ' "1.10" ': (110, 2), "7,8": (7, 0), "7]": (7, 0), "-9223372036854775807": (-(2**63) + 1, 0),
        "0.05000000": (5000000, 8), "9223372036854775808": None, "1e-8": None, "1.1234567890123456789": None, "": None,
        "9223372036854775807": None, "1.2.3": None, "-": None, "+1": None, "1x": None, "-9223372036854775808": None, ".": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("p", fn.fixed_point(F.col("t"))).collect()
    assert {r["t"]: tuple(r["p"]) if r["p"] else None for r in rows} == cases


def test_times(spark):
    cases = {
        "1970-01-01T00:00:01Z": 1_000_000_000, "2023-02-09T20:33:09.999999Z": 1675974789999999000,
        "2024-02-29T00:00:00.1Z": 1709164800100000000, ' "1970-01-01T00:00:01Z"\n': 1_000_000_000, "null": -1, "": -1,
        "1970-01-01T00:00:00Z": -1, "2023-02-30T20:33:09Z": -1, "2023-02-09T20:33:09.1234567890Z": -1,
        "2023-02-09T20:33:09": -1, "2023-02-09T24:00:00Z": -1, "2023-02-09T20:33:09.Z": -1, "2300-01-01T00:00:00Z": -1,
        "1969-12-31T23:59:59Z": -1_000_000_000, '"1970-01-01T00:00:01Z': -1,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("p", fn.rfc3339_nanos(F.col("t"))).collect()
    assert {r["t"]: r["p"] for r in rows} == cases


def test_timestamp_values(spark):
    for text, want in {'"1970-01-01T00:00:01Z",': 10**9, "null,": -1, "1970-01-01T00:00:01Z}": 10**9, "": -1}.items():
        assert one(spark, fn.timestamp_value(F.col("t")), text) == want


def test_uuids(spark):
    whole = "d50ec984-77a8-460a-b958-66f114b0de9b"
    halves = (-3094314323176569334, -5091206193122058597)
    shifted = "-" + whole[:2] + "--" + whole[2:]
    for text, want in {
        shifted: halves, whole: halves, whole.upper(): halves, whole.replace("-", ""): halves, whole + "ff": halves,
        whole[:-1]: None, "x" + whole: None, "d-50ec984" + whole[8:]: None,
    }.items():
        got = one(spark, fn.uuid_halves(F.col("t")), text)
        assert (tuple(got) if got else None) == want, text
    zero = "00000000-0000-0000-0000-000000000000"
    assert one(spark, fn.uuid_halves(F.col("t"), allow_zero=False), zero) is None
    assert one(spark, fn.uuid_text(F.lit(halves[0]), F.lit(halves[1])), "") == whole


def test_json_lookup(spark):
    t = F.col("t")
    frame = '{"a" : "x", "b":1.10, "c": "q\\"z", "d" :{"e":"in"},"f": null, "g":"", "a":"second"}'
    assert one(spark, fn.json_string(t, "a"), frame) == "x"
    assert one(spark, fn.json_string(t, "b"), frame) is None
    assert one(spark, fn.json_raw(t, "b"), frame) == "1.10"
    assert one(spark, fn.json_string(t, "c"), frame) is None
    assert one(spark, fn.json_string(t, "e"), frame) == "in"
    assert one(spark, fn.json_string(t, "g"), frame) == ""
    assert one(spark, fn.json_string(t, "zz"), frame) is None
    # The first occurrence decides, even when its value is not a string.
    assert one(spark, fn.json_string(t, "type"), '{"type":5,"x":{"type":"late"}}') is None
    # A truncated frame still yields its leading keys.
    assert one(spark, fn.json_string(t, "type"), '{"type":"snapshot","bids":[["1') == "snapshot"
    assert one(spark, fn.json_array(t, "bids"), '{"type":"snapshot","bids":[["1') is None
    assert one(spark, fn.json_array(t, "k"), '{"k": [[1,"]"],[2]] , "z":[3]}') == '[[1,"]"],[2]]'
    assert one(spark, fn.json_array(t, "k"), '{"k": ["a\\"b"]}') is None


def test_long_arrays_do_not_overflow_the_matcher(spark):
    pairs = ",".join(f'["{i}.25","{i}.5"]' for i in range(20_000))
    text = '{"bids":[' + pairs + '],"asks":[]}'
    got = one(spark, F.size(fn.quoted_strings(fn.json_array(F.col("t"), "bids"))), text)
    assert got == 40_000


def test_longs(spark):
    t = F.col("t")
    strict = {"12": 12, "-5": None, "": None, "9223372036854775807": None, "92233720368547758070": None, "1a": None}
    prefix = {"12": 12, "-5": 0, "": 0, "92233720368547758070": 2**63 - 1, "1a": 1}
    assert {k: one(spark, fn.json_long_strict(t), k) for k in strict} == strict
    assert {k: one(spark, fn.json_long_prefix(t), k) for k in prefix} == prefix


def test_labels(spark):
    t = F.col("t")
    names = {"  frames received ": "frames_received", "9x": "_9x", "a:b": "a:b", "...": "fb", "": "fb", "x__": "x"}
    assert {k: one(spark, fn.metric_name(t, F.lit("fb")), k) for k in names} == names
    labels = {"instanceId": "instance_id", " instrumentId ": "instrument_id", "a:b": "a_b", "": "", "7": "_7"}
    assert {k: one(spark, fn.label_name(t), k) for k in labels} == labels
    assert one(spark, fn.escape_label(t), 'a\\b"c\nd') == 'a\\\\b\\"c\\nd'
    pairs = one(spark, fn.parse_label(t), "m,a=1,=2,b,c==3,instanceId=")
    assert [tuple(p) for p in pairs] == [("a", "1"), ("c", "=3"), ("instance_id", "")]
    assert one(spark, fn.parse_label(t), "only") == []


def test_fixed_value_compares_across_scales(spark):
    rows = spark.createDataFrame([(110, 2, 11, 1), (-5, 1, -50, 2), (2**63 - 1, 0, 1, 0)], "a bigint, b int, c bigint, d int")
    v = rows.select(fn.fixed_value(F.col("a"), F.col("b")).alias("x"), fn.fixed_value(F.col("c"), F.col("d")).alias("y")).collect()
    assert v[0]["x"] == v[0]["y"] and v[1]["x"] == v[1]["y"]
    assert str(v[2]["x"]).startswith("9223372036854775807")


def test_arrays_nested_without_limit(spark):
    from feedlake.functions.jsontext import first_object_named, json_array

    rows = []
    for depth in range(1, 13):
        array = "[" * depth + '1,"]"' + "]" * depth
        objects = '[{"k":' + '{"k":' * depth + "1" + "}" * depth + '},{"name":"hit","v":' + '{"a":' * depth + "1" + "}" * depth + "}]"
        rows.append((array, f'{{"x":[0],"bids": {array},"z":[3]}}', objects))
    df = spark.createDataFrame(rows, "want string, text string, objects string")
    got = df.select("want", json_array(F.col("text"), "bids").alias("array"), first_object_named(F.col("objects"), "hit").alias("hit"))
    for depth, r in enumerate(got.collect(), 1):
        assert r.array == r.want
        assert r.hit == '{"name":"hit","v":' + '{"a":' * depth + "1" + "}" * depth + "}"


def test_a_lookup_inside_a_lambda_runs_its_pattern_once(spark):
    from pyspark.sql import functions as F

    from feedlake.functions.binding import let
    from feedlake.functions.jsontext import json_raw, json_string

    df = spark.createDataFrame([('{"a":"x","b":""}',)], "t string").select(F.col("t"))
    found = df.select(let(F.col("t"), lambda t: json_string(t, "a")).alias("a"), json_raw("t", "c").alias("c"))
    assert tuple(found.first()) == ("x", None)
    lookup = df.select(let(F.col("t"), lambda t: json_string(t, "a")).alias("a"))
    assert lookup._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
