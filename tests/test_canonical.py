import json
import random

from pyspark.sql import functions as F

from tallyloom.functions import text

NUMBERS = [0.1, 1.0, -0.0, 0.0, 1e16, 1e15, 123456789.125, 1e-4, 1e-5, 2.5e-7, 1e22, 1.5e300, -3.25, 100.0, 12345678.0, 1e100]
PIECES = ["a", "b", " ", ",", ":", '"', "\\", "\n", "\t", "{", "}", "[", "]", "é", "数", "1.5", "1e5", "/", "😀", "\x7f", "\x1f", "\x01"]
ODD = [
    None, "", "  ", "no", '{"a":1} x', '{"a":1}{"b":2}', "1,2", "[1,]", "01", "01.5", "1.5abc", '"a" "b"', "-0", "[-0, -0.0, 0]", "1E400", "-1E400", "[123456789012345678901234567890123456789012345,1]",
    "1.0E+2", '"tab\tin"', '{"x":1.50,"a":"1.50"}', "  [1 , 2]  ", "tru", "true", "null", '"x"', "1", "[1.5}", "{1.5: 2}", "{1: 2}", '{"a": {-0: 1}}', "1.", "1e", "-", "-01", "1.5.5", "1.5-2", '1.5"a"', "[1 2]", "[1.5 2]", ".5", "+1", "[-]", "00", "[0 1.5]", r'{"a":"x\\u001F"}', r'"\\\u001F"', "[]", "{}", '"' + "x" * 100_000 + '"', "[" + "1.5," * 5000 + "{}]",
]


def python(raw):
    if not raw:
        return ""
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return raw


def test_as_python_writes_it(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, n)))

    def value(depth):
        kind = rnd.randint(0, 9 if depth else 6)
        if kind < 4:
            return [rnd.choice([None, True, False]), rnd.randint(-(10**20), 10 ** rnd.randint(0, 20)), rnd.choice(NUMBERS), round(rnd.uniform(-1000, 1000), rnd.randint(0, 6))][kind]
        return word(8) if kind <= 6 else [value(depth - 1) for _ in range(rnd.randint(0, 4))] if kind == 7 else {word(3): value(depth - 1) for _ in range(rnd.randint(0, 4))}

    rows = [json.dumps(value(3), ensure_ascii=rnd.random() < 0.5, separators=rnd.choice([(",", ":"), (", ", ": "), (" , ", " :\n")])) for _ in range(1500)] + ODD
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, v string").select("i", text.canonical_json(F.col("v")).alias("c"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    for r in frame.collect():
        assert r.c == python(rows[r.i]), rows[r.i]


def test_keys_named_twice_and_constants_are_no_json(spark):
    rows = ['{"a":1,"a":2}', "NaN", '{"x": Infinity}']
    frame = spark.createDataFrame([(r,) for r in rows], "v string").select("v", text.canonical_json(F.col("v")).alias("c"))
    assert all(r.c == r.v for r in frame.collect())
