"""Property tests: predicates agree with Python's own parsers on generated
text; pack/unpack is an identity on generated images; replay of a diff
rebuilds the edited snapshot."""

import datetime as dt
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions.images import pack_image, unpack_image
from vellum.functions.predicates import is_integer, is_number
from vellum.operators.diff import ChangeMeta, diff_updates
from vellum.operators.replay import replay

NUM_ALPHABET = "0123456789+-._eE "
SETTINGS = settings(max_examples=15, deadline=None, derandomize=True,
                    suppress_health_check=list(HealthCheck))


def py_ok(fn, v):
    if v.strip() == "":
        return False
    try:
        fn(v)
        return True
    except ValueError:
        return False


@SETTINGS
@given(st.lists(st.text(alphabet=NUM_ALPHABET, min_size=1, max_size=8), min_size=40, max_size=40))
def test_number_grammar(spark, values):
    values += ["inf", "-Infinity", "nan", "1_000.5e-1_0", ".5", "5.", "1__2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", is_integer(F.col("v")).alias("a"), is_number(F.col("v")).alias("b")).collect()
    for r in got:
        v = values[r["i"]]
        assert r["a"] == py_ok(int, v), ("int", v)
        assert r["b"] == py_ok(float, v), ("float", v)


# backslashes are left out: the legacy reader treats "\\x" as an escape of x
# (tested separately), so only "," and "|" round-trip through the text form
VAL = st.text(alphabet="ab,|{} =xé", max_size=6)


@SETTINGS
@given(st.lists(st.fixed_dictionaries({}, optional={"f1": VAL, "f2": VAL, "f3": VAL}), min_size=20, max_size=20))
def test_pack_unpack_agrees_with_reader_model(spark, images):
    """Whatever pack writes, unpack reads exactly as the legacy reader model
    does; and when no outer whitespace or braces are involved, the round trip
    is the identity."""
    from tests.test_functions import model_unpack
    fields = ["f1", "f2", "f3"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(images)], "i int, m map<string,string>")
    out = (df.select("i", pack_image(F.col("m"), fields).alias("p"))
           .select("i", "p", unpack_image(F.col("p"), fields).alias("b")).collect())
    for r in out:
        m = images[r["i"]]
        assert (r["b"] or {}) == model_unpack(r["p"], fields), (m, r["p"], r["b"])
        p = r["p"]
        if m and p == p.strip() and not (p.startswith("{") and p.endswith("}")) and set(p) - {","}:
            assert r["b"] == {f: m.get(f, "") for f in fields}, (m, p, r["b"])


def test_replay_of_diff_rebuilds_edited(spark):
    rng = random.Random(3)
    rows = [(str(i), f"n{i}", rng.choice(["a", "b", "c"])) for i in range(300)]
    edited = [(k, n + ("*" if rng.random() < 0.3 else ""), s if rng.random() < 0.7 else "z") for k, n, s in rows]
    b = spark.createDataFrame(rows, "id string, name string, seg string")
    e = spark.createDataFrame(edited, "id string, name string, seg string")
    ch = diff_updates(b, e, "id", ChangeMeta("d", "t", "u", dt.datetime(2024, 1, 1), "s"))
    out = replay(b, ch, "id")
    assert out.exceptAll(e).isEmpty() and e.exceptAll(out).isEmpty()


def test_clean_cast_table_has_no_problems(spark):
    """Text written from typed values always passes its own contract."""
    from vellum.operators import contract
    rng = random.Random(9)
    rows = [(rng.randint(-10**12, 10**12), rng.uniform(-1e6, 1e6), rng.random() < 0.5,
             dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(20000)),
             dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randrange(10**9)))
            for _ in range(500)]
    typed = spark.createDataFrame(rows, "a long, b double, c boolean, d date, e timestamp_ntz")
    text = typed.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"),
                        F.col("c").cast("string").alias("c"), F.date_format("d", "yyyy-MM-dd").alias("d"),
                        F.date_format("e", "yyyy-MM-dd HH:mm:ss").alias("e"))
    c = {"schema": {"fields": [{"name": "a", "type": "int", "required": True},
                               {"name": "b", "type": "float", "required": True},
                               {"name": "c", "type": "bool"}, {"name": "d", "type": "date"},
                               {"name": "e", "type": "datetime"}]}}
    assert contract.violations(text, c).count() == 0
    assert contract.violation_count(text, c) == 0


def _py_formats(v, fmts):
    if v.strip() == "":
        return False
    for f in fmts:
        try:
            dt.datetime.strptime(v, f)
            return True
        except ValueError:
            pass
    return False


PART = st.one_of(st.integers(0, 39).map(str), st.integers(0, 9).map(lambda d: f"0{d}"),
                 st.integers(1, 9).map(lambda d: f" {d}"), st.integers(1990, 2030).map(str),
                 st.sampled_from(["0000", "00", "2024", "29", "30", "31", "12", "13", "60", "59", "x"]))
SEP = st.sampled_from(["-", "/", ":", " ", "T", "t", "  ", ""])


@SETTINGS
@given(st.lists(st.lists(st.tuples(PART, SEP), min_size=1, max_size=6).map(
    lambda parts: "".join(p + s for p, s in parts)), min_size=60, max_size=60))
def test_date_predicates_match_strptime(spark, values):
    from tests.test_functions import DATE_FMTS, DATETIME_FMTS
    from vellum.functions.predicates import is_date, is_datetime
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", is_date(F.col("v")).alias("d"), is_datetime(F.col("v")).alias("t")).collect()
    for r in got:
        v = values[r["i"]]
        assert r["d"] == _py_formats(v, DATE_FMTS), ("date", v)
        assert r["t"] == _py_formats(v, DATETIME_FMTS), ("datetime", v)


FIELD = {
    "Y": st.sampled_from(["2024", "2023", "1999", "0000", "0001", "999", "20245", "2o24"]),
    "m": st.sampled_from(["1", "01", "12", "13", "00", "0", " 1", "7", "09"]),
    "d": st.sampled_from(["1", "01", "28", "29", "30", "31", "32", "00", " 5", "9", "  5"]),
    "H": st.sampled_from(["0", "00", "9", "23", "24", "12"]),
    "M": st.sampled_from(["0", "00", "5", "59", "60"]),
    "S": st.sampled_from(["0", "00", "7", "59", "60", "61"]),
}
LAYOUT_FMTS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y",
               "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M",
               "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]


@st.composite
def formatted(draw):
    fmt = draw(st.sampled_from(LAYOUT_FMTS))
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            out.append(draw(FIELD[fmt[i + 1]]))
            i += 2
        else:
            out.append(fmt[i])
            i += 1
    s = "".join(out)
    tweak = draw(st.sampled_from(["", "", "", "lead", "trail", "lower", "double_space"]))
    if tweak == "lead":
        s = " " + s
    elif tweak == "trail":
        s = s + " "
    elif tweak == "lower":
        s = s.lower()
    elif tweak == "double_space":
        s = s.replace(" ", "  ", 1)
    return s


@SETTINGS
@given(st.lists(formatted(), min_size=80, max_size=80))
def test_formatted_dates_match_strptime(spark, values):
    from tests.test_functions import DATE_FMTS, DATETIME_FMTS
    from vellum.functions.predicates import is_date, is_datetime
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", is_date(F.col("v")).alias("d"), is_datetime(F.col("v")).alias("t")).collect()
    bad = []
    for r in got:
        v = values[r["i"]]
        if r["d"] != _py_formats(v, DATE_FMTS) or r["t"] != _py_formats(v, DATETIME_FMTS):
            bad.append((v, r["d"], r["t"], _py_formats(v, DATE_FMTS), _py_formats(v, DATETIME_FMTS)))
    assert not bad, bad[:5]


def _infer_model(values):
    """The inference rules of SURVEY C4, directly in Python."""
    import re as _re
    vals = [v for v in values if v is not None]
    if not vals:
        return "object"
    s = [v.strip() for v in vals]
    if all(_re.match(r"^-?\d+$", x, _re.ASCII) for x in s):
        return "int64"
    if all(_re.match(r"^-?\d*\.?\d+([eE][+-]?\d+)?$", x.replace(",", "."), _re.ASCII) for x in s):
        return "float64"
    words = {"true", "false", "1", "0", "yes", "no", "sim", "não", "verdadeiro", "falso"}
    if all(x.lower() in words for x in s):
        return "bool"
    pats = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]
    if all(any(_re.match(p, x, _re.ASCII) for p in pats) for x in s):
        return "datetime64"
    return "object"


CELL = st.one_of(st.none(), st.sampled_from(["1", "-2", " 3 ", "1.5", "2,5", ".5", "1e3", "true", "Sim", "NÃO",
                                             "yes", "2024-01-05", "05/01/2024x", "05-01-2024", "abc", "", " ",
                                             "0", "falso", "-", "1-2"]))


@SETTINGS
@given(st.lists(st.lists(CELL, min_size=6, max_size=6), min_size=1, max_size=12))
def test_infer_types_matches_rules(spark, rows):
    from vellum.operators.profile import infer_types
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    got = {r["column"]: r["inferred_type"] for r in infer_types(df).collect()}
    for i, c in enumerate(cols):
        assert got[c] == _infer_model([r[i] for r in rows]), (c, [r[i] for r in rows])


ROWS = st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", None, ""])), max_size=25)


@SETTINGS
@given(ROWS, ROWS)
def test_change_summary_matches_python(spark, before_rows, after_rows):
    from collections import Counter
    from vellum.operators.diff import change_summary
    b = spark.createDataFrame(before_rows, "k int, v string")
    a = spark.createDataFrame(after_rows, "k int, v string")
    # multiset form
    cb, ca = Counter(before_rows), Counter(after_rows)
    diff = sum(((cb - ca) + (ca - cb)).values())
    s = change_summary(b, a).first()
    assert (s["n_before"], s["n_after"], s["n_differing"]) == (len(before_rows), len(after_rows), diff)
    assert s["changed"] == (len(before_rows) != len(after_rows) or diff > 0)
    # keyed form on the first row per key (unique keys)
    ub = list({k: (k, v) for k, v in reversed(before_rows)}.values())
    ua = list({k: (k, v) for k, v in reversed(after_rows)}.values())
    bk, ak = dict(ub), dict(ua)
    norm = lambda v: "" if v is None else v
    n_diff = sum(1 for k in set(bk) | set(ak)
                 if k not in bk or k not in ak or norm(bk[k]) != norm(ak[k]))
    s = change_summary(spark.createDataFrame(ub, "k int, v string"),
                       spark.createDataFrame(ua, "k int, v string"), "k").first()
    assert (s["n_before"], s["n_after"], s["n_differing"]) == (len(ub), len(ua), n_diff)


def test_replay_of_diff_rebuilds_typed_table(spark):
    """Typed columns survive the text images: diff, then replay, gives back
    the edited snapshot with its types."""
    rng = random.Random(17)
    rows = [(i, rng.uniform(-1e6, 1e6), rng.random() < 0.5, dt.date(2020, 1, 1) + dt.timedelta(days=i))
            for i in range(200)]
    edited = [(k, x * 3.0000001 if rng.random() < 0.3 else x, (not f) if rng.random() < 0.2 else f, d)
              for k, x, f, d in rows]
    schema = "id long, amount double, flag boolean, day date"
    b, e = spark.createDataFrame(rows, schema), spark.createDataFrame(edited, schema)
    ch = diff_updates(b, e, "id", ChangeMeta("d", "t", "u", dt.datetime(2024, 1, 1), "s"))
    out = replay(b, ch, "id")
    assert out.dtypes == e.dtypes
    assert out.exceptAll(e).isEmpty() and e.exceptAll(out).isEmpty()
