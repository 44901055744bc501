"""Nested decoding and type conformance."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import text
from tarnlake.operators.conform import conform_hive, conform_jdbc, jdbc_type, parse_type, widen_jdbc
from tarnlake.operators.nested import MIXED_ARRAY, decode_nested, decode_rows, encode_nested
from tarnlake.operators.shape import flatten_struct, nest_columns
from tarnlake.plans import QUERIES
from tarnlake.sources.files import scan_json_texts


def decode(spark, value, declared, **kw):
    df = spark.createDataFrame([(value,)], "c string")
    return decode_nested(df, {"c": declared}, **kw).first()[0]


def test_empty_array_is_null_unless_kept(spark):
    assert decode(spark, "[]", "array<int>") is None
    assert decode(spark, "[]", "array<int>", empty_as_null=False) == []
    assert decode(spark, None, "array<int>") is None


def test_struct_with_one_field_and_inner_struct(spark):
    assert decode(spark, '{"a": {"b": 1}}', "struct<a:struct<b:int>>").a.b == 1


def test_primitive_array_in_struct_and_deep_nesting(spark):
    got = decode(
        spark,
        '[{"tags": ["x", null], "in": [{"n": [1, 2]}]}]',
        "array<struct<tags:array<string>,in:array<struct<n:array<bigint>>>>>",
    )
    assert got[0].tags == ["x", None] and got[0]["in"][0].n == [1, 2]


def test_leaves(spark):
    got = decode(
        spark,
        '{"t":1,"s":2,"d":12.34,"f":0.5,"w":3,"b":true,"bin":"AAE=","dt":"2020-01-02T03:04:05Z","n":null}',
        "struct<t:tinyint,s:smallint,d:decimal(10,2),f:float,w:double,b:boolean,bin:binary,dt:date,n:string>",
    )
    assert (got.t, got.s, got.d, got.f, got.w, got.b) == (1, 2, decimal.Decimal("12.34"), 0.5, 3.0, True)
    assert bytes(got.bin) == b"\x00\x01" and got.dt == datetime.date(2020, 1, 2) and got.n is None


def test_timestamps_with_zone(spark):
    for stamp in ("2020-01-02T03:04:05Z", "2020-01-02T12:04:05+0900", "2020-01-02T12:04:05+09:00", "2020-01-02T03:04:05.000Z"):
        df = spark.createDataFrame([('{"t":"%s"}' % stamp,)], "c string")
        out = decode_nested(df, {"c": "struct<t:timestamp>"}).select(F.unix_seconds("c.t")).first()[0]
        assert out == 1577934245, stamp
        direct = spark.createDataFrame([(stamp,)], "c string").select(F.unix_seconds(text.iso_timestamp(F.col("c"))))
        assert direct.first()[0] == 1577934245, stamp


def test_wrong_leaf_is_null_rest_is_kept(spark):
    got = decode(spark, '{"a":"x","b":2}', "struct<a:bigint,b:bigint>")
    assert got.a is None and got.b == 2


def test_map_and_varchar(spark):
    assert decode(spark, '{"a":1}', "map<string,int>") == {"a": 1}
    assert decode(spark, '["ab"]', "array<varchar(1)>") == ["ab"]


def test_encode_reverses_decode(spark):
    source = '[{"a":1,"b":null}]'
    df = spark.createDataFrame([(source,)], "c string")
    out = encode_nested(decode_nested(df, {"c": "array<struct<a:int,b:string>>"}), ["c"])
    assert out.first()[0] == source


def test_parse_type():
    assert parse_type("DECIMAL(10,2)").simpleString() == "decimal(10,2)"
    assert parse_type("char(3)").simpleString() == "string"
    assert parse_type("uniontype<int,string>").simpleString() == "string"
    assert parse_type("array<struct<place:string,day:date,visits:int>>").simpleString() == (
        "array<struct<place:string,day:date,visits:int>>"
    )


def test_jdbc_types():
    assert jdbc_type("bigint") == "bigint" and jdbc_type("BIGINT", signed=False) == "decimal(20,0)"
    assert jdbc_type("integer", signed=False) == "bigint" and jdbc_type("tinyint", signed=False) == "int"
    assert jdbc_type("DISTINCT") is None and jdbc_type("TIME") == "timestamp"


def test_conform_jdbc(spark):
    df = spark.createDataFrame([("12", "x", decimal.Decimal("1.25"))], "a string, b string, c decimal(9,2)")
    out = conform_jdbc(df, {"a": "SMALLINT", "b": "INTEGER", "c": "NUMERIC"})
    assert out.dtypes == [("a", "int"), ("b", "int"), ("c", "double")]
    assert tuple(out.first()) == (12, None, 1.25)


def test_widen_jdbc(spark):
    df = spark.sql("SELECT CAST(1 AS TINYINT) a, 1.5BD b, 'x' c, TIMESTAMP_NTZ'2020-01-01 00:00:00' d")
    assert widen_jdbc(df).dtypes == [("a", "int"), ("b", "double"), ("c", "string"), ("d", "timestamp")]


def test_conform_hive(spark):
    df = spark.createDataFrame([("7", '[{"x":1}]', "2020-01-02", "drop")], "a string, b string, c string, d string")
    out = conform_hive(df, {"c": "date", "a": "tinyint", "b": "array<struct<x:bigint>>"})
    assert out.columns == ["c", "a", "b"]
    row = out.first()
    assert (row.c, row.a, row.b[0].x) == (datetime.date(2020, 1, 2), 7, 1)


def test_flatten_then_nest_is_identity(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', 'z') AS s")
    flat = flatten_struct(df, "s")
    assert flat.columns == ["a", "x", "y"]
    assert nest_columns(flat, ["x", "y"], "s").first() == df.first()


def test_decode_rows_parses_once(spark, folder):
    rows = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, "[]"), (3, None)], "id int, c string")
    rows.write.parquet(folder)
    out = decode_rows(spark.read.parquet(folder), "c", "array<struct<a:int>>")
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2)]
    # Parsed where it is unfolded and in no filter before; there in place, and once more only where an element is missing.
    holders = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "from_json" in line]
    assert len(holders) == 1 and "Generate" in holders[0]


def test_wrong_elements_leave_the_rest_of_an_array(spark):
    texts = ['[1,"x",3]', "[]", None, "[null, 2.5, true, {}]", "no json"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r.t for r in decode_nested(frame, {"t": "array<int>"}, empty_as_null=False).collect()]
    assert out[:3] == [[1, None, 3], [], None] and out[3][0] is None and out[3][2:] == [None, None] and not out[4]
    deep = spark.createDataFrame([('{"a":[1,"x"],"b":2,"c":[{"d":["YQ==","?"]},null]}',)], "t string")
    row = decode_nested(deep, {"t": "struct<a:array<int>,b:int,c:array<struct<d:array<binary>>>>"}).first().t
    assert row.a == [1, None] and row.b == 2 and bytes(row.c[0].d[0]) == b"a" and row.c[1] is None
    flags = spark.createDataFrame([('[true,"false",1,"no"]',)], "t string")
    assert decode_nested(flags, {"t": "array<boolean>"}).first().t == [True, False, None, None]
    times = spark.createDataFrame([('["2024-05-06T07:08:09Z","later"]',)], "t string")
    found = decode_nested(times, {"t": "array<timestamp>"}).select(F.unix_seconds(F.col("t")[0]), F.col("t")[1]).first()
    assert tuple(found) == (1714979289, None)


def test_fields_named_like_columns(spark):
    frame = spark.createDataFrame([(1, '[{"K":2}]')], "k int, t string")
    with pytest.raises(ValueError, match="already exist"):
        decode_rows(frame, "t", "array<struct<K:int>>")
    with pytest.raises(ValueError, match="already exist"):
        scan_json_texts(frame.withColumn("t", F.lit('{"k":2}')), "t")


@pytest.mark.parametrize(
    "text, declared, want",
    [
        ('{"a":1,"b":"x"}', "map<string,int>", {"a": 1, "b": None}),
        ('{"a":1,"b":"2"}', "map<string,int>", {"a": 1, "b": 2}),
        ('{"a":"AAE=","b":1}', "map<string,binary>", {"a": bytearray(b"\x00\x01"), "b": None}),
        ('{"a":"true","b":1}', "map<string,boolean>", {"a": True, "b": None}),
        ('[{"a":1},5]', "array<struct<a:int>>", [(1,), None]),
        ('[{"a":1},null,{"a":"x"},{}]', "array<struct<a:int>>", [(1,), None, (None,), (None,)]),
        ('[[1,"x"],7,[]]', "array<array<int>>", [[1, None], None, []]),
        ('{"a":{"x":1},"b":3}', "map<string,map<string,int>>", {"a": {"x": 1}, "b": None}),
        ('{"s":[{"t":[{"u":1},"v"]},9],"n":2}', "struct<s:array<struct<t:array<struct<u:int>>>>,n:int>", ([([(1,), None],), None], 2)),
        ('{"s":{"q":[{"a":1},5]},"n":2}', "struct<s:struct<q:array<struct<a:int>>>,n:int>", (([(1,), None],), 2)),
        ('{"s":null,"n":2}', "struct<s:array<struct<a:int>>,n:int>", (None, 2)),
        ('{"s":4,"n":2}', "struct<s:array<array<int>>,n:int>", (None, 2)),
        ('{"n":2}', "struct<s:map<string,array<int>>,n:int>", (None, 2)),
        ('[[{"a":1}],{"a":2}]', "array<array<struct<a:int>>>", [[(1,)], None]),
        ('[["a",1,{"b":2}]]', "array<array<string>>", [["a", "1", '{"b":2}']]),
        ("null", "array<struct<a:int>>", None),
        ("nonsense", "map<string,array<int>>", None),
        ("[]", "array<array<int>>", None),
        ("{}", "map<string,array<int>>", {}),
    ],
)
def test_wrong_elements_go_alone(spark, text, declared, want):
    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        return type(value)(map(plain, value)) if isinstance(value, list) else tuple(map(plain, value)) if isinstance(value, tuple) else value

    # Beside a well-formed row, and by a column, so that nothing is folded.
    df = spark.createDataFrame([(text,), (None,)], "c string")
    got = [r[0] for r in decode_nested(df, {"c": declared}).collect()]
    assert plain(got[0]) == want and got[1] is None


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("from_json(")


def test_a_text_is_parsed_once(spark, sf_dir):
    df = spark.createDataFrame([('{"a":1,"b":[1],"c":{"x":2}}',)], "c string")
    rows = decode_nested(df, {"c": "struct<a:int,b:array<int>,c:map<string,int>,d:array<binary>>"})
    assert parses(rows.select("c.a", "c.b", "c.c", "c.d", F.col("c.b")[0], "c")) == 1
    assert parses(QUERIES["decode_leaves"](spark, sf_dir)) == 1


def test_mixed_arrays_are_read_from_texts_at_once(spark):
    """a text that shows a wrong element is not first parsed in place, where each one is a caught exception."""
    texts = ['[{"a":1},5,{"a":2}]', '[{"a":1},"z"]', '["z",{"a":1}]', '[{"a":1}, {"a":2}]', '[{"a":1},{"b":"x,{y"}]', "[]", "null", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    shown = [r[0] for r in frame.orderBy("i").select(F.col("t").rlike(MIXED_ARRAY)).collect()]
    assert shown == [True, True, True, False, True, False, False, False, None]
    out = [r.t and [x and x.a for x in r.t] for r in decode_nested(frame, {"t": "array<struct<a:int>>"}).orderBy("i").collect()]
    assert out == [[1, None, 2], [1, None], [None, 1], [1, 2], [1, None], None, None, None, None]
    inner = frame.where("t is null or t != ''").select("i", F.concat(F.lit('{"s":'), "t", F.lit(',"n":1}')).alias("t"))
    rows = decode_nested(inner, {"t": "struct<s:array<struct<a:int>>,n:int>"}).orderBy("i").collect()
    assert [r.t and (r.t.s and [x and x.a for x in r.t.s], r.t.n) for r in rows] == [
        ([1, None, 2], 1), ([1, None], 1), ([None, 1], 1), ([1, 2], 1), ([1, None], 1), ([], 1), (None, 1), None,
    ]
    # The parse in place is made only where none shows.
    plan = decode_nested(frame, {"t": "array<struct<a:int>>"})._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT RLIKE" in plan.upper()
