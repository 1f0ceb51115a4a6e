"""Newest version wins: values by hand, properties against a Python dict, and plans."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import lookup, resolve
from tidelog.schema import CHANGE, changes

KIND = "key binary, value binary, op tinyint, seq long"


def log_of(spark, rows):
    """'+k=v' and '-k' in order."""
    out = []
    for n, r in enumerate(rows):
        key, _, value = r[1:].partition("=")
        out.append((bytearray(key.encode()), bytearray(value.encode()) if r[0] == "+" else None, 0 if r[0] == "+" else 1, n + 1))
    return spark.createDataFrame(out, CHANGE)


def live(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


@pytest.mark.parametrize(("rows", "expected"), [
    (["+foo=bar"], {"foo": "bar"}),
    (["+a=lot", "+of=keys", "+into=this", "+bad=boy", "+!!!!=!!!!", "-a", "+a=dude"], {"a": "dude", "of": "keys", "into": "this", "bad": "boy", "!!!!": "!!!!"}),
    (["+foo=bar", "-foo", "-foo"], {}),
    (["+foo=bar", "+foo=baz"], {"foo": "baz"}),
    (["+foo=bar", "-foo", "+foo=baz", "+oooooh=wweeee"], {"foo": "baz", "oooooh": "wweeee"}),
    (["-ghost"], {}),
    (["+=empty key", "+x="], {"": "empty key", "x": ""}),
])
def test_snapshot(spark, rows, expected):
    assert live(resolve.snapshot(log_of(spark, rows))) == expected


def test_deletions_tell_what_was_there(spark):
    rows = resolve.deletions(log_of(spark, ["+foo=bar", "-foo", "-foo", "-new"])).orderBy("seq").collect()
    assert [r.was_present for r in rows] == [True, False, False]


def test_size_counts_keys_and_values(spark):
    assert resolve.live_bytes(log_of(spark, ["+howdy=time", "+awww=yeah"])).first()[0] == 17
    assert resolve.live_bytes(spark.createDataFrame([], CHANGE)).first()[0] == 0


def test_merge_takes_the_newest_and_keeps_deletions(spark):
    runs = [log_of(spark, r).withColumn("seq", F.lit(k)) for k, r in enumerate([["+baz=bax", "+foo=bar"], ["+aaa=blarg", "+foo=butt"], ["+howdy=time", "+yerrr=ayyy"], ["+ohhh=brother", "+whoomp=there it is"]])]
    merged = resolve.merge(runs)
    assert live(merged) == {"aaa": "blarg", "baz": "bax", "foo": "butt", "howdy": "time", "ohhh": "brother", "whoomp": "there it is", "yerrr": "ayyy"}
    masked = resolve.merge([log_of(spark, ["+k=v", "-k"]), log_of(spark, ["+=old"])])
    assert {(bytes(r.key), r.op, r.value and bytes(r.value)) for r in masked.collect()} == {(b"k", 1, None), (b"", 0, b"old")}
    assert resolve.merge([log_of(spark, ["+k=v", "-k"])], drop_tombstones=True).count() == 0


def test_layers_win_by_position_and_deletions_mask(spark):
    runs = [log_of(spark, ["-k"]), log_of(spark, ["+k=old", "+j=1"]), log_of(spark, ["+j=0"])]
    assert live(resolve.layered(runs)) == {"j": "1"}


def test_byte_order(spark):
    keys = [b"\xff", b"\x80", b"\x7f", b"", b"\x80\x00"]
    df = spark.createDataFrame([(bytearray(k), bytearray(b"v"), 0, n) for n, k in enumerate(keys)], CHANGE)
    assert [bytes(r.key) for r in resolve.snapshot(df).orderBy("key").collect()] == [b"", b"\x7f", b"\x80", b"\x80\x00", b"\xff"]


def test_changes_fill_in_ops_and_empty_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "key string, value string, seq long")
    assert live(resolve.snapshot(changes(df))) == {"a": "", "b": "x"}


def test_flush_point(spark):
    assert [tuple(r) for r in resolve.flush_points(log_of(spark, ["+ab=cd", "+e=f", "-x", "+gh=ij"]), 6).collect()] == [(0, 3, 7)]
    assert resolve.flush_points(log_of(spark, ["+ab=cd"]), 6).count() == 0 and resolve.flush_points(log_of(spark, []), 6).count() == 0


@pytest.mark.parametrize(("limit", "buckets", "slices"), [(0, 1, 4), (500, 1, 4), (500, 3, 8), (1500, 2, 64), (10**6, 1, 4)])
def test_flush_points_by_slices(spark, limit, buckets, slices):
    log = log_of(spark, [f"+k{n % 17}={'v' * (n % 9)}" if n % 5 else f"-k{n % 17}" for n in range(300)])
    of = {r.key: r.b for r in log.select("key", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("b")).distinct().collect()} if buckets > 1 else {}
    want, so_far = {}, {}
    for r in sorted(log.collect(), key=lambda r: r.seq):
        b = of.get(r.key, 0)
        so_far[b] = so_far.get(b, 0) + len(r.key) + (len(r.value or "") if r.op == 0 else 0)
        if so_far[b] > limit:
            want.setdefault(b, (r.seq, so_far[b]))
    assert {r.bucket: (r.seq, r.bytes) for r in resolve.flush_points(log, limit, buckets, slices).collect()} == want


def test_filter_on_key_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    log_of(spark, ["+a=1", "+b=2", "-a"]).write.parquet(path)
    plan = lookup.get(spark.read.parquet(path), bytearray(b"a"))._jdf.queryExecution().toString()
    assert "EqualTo(key" in plan and "Python" not in plan


def test_scans(spark):
    log = log_of(spark, ["+10=a", "+11=b", "+2=c", "-11", "+\xff=d"])
    assert live(lookup.range_scan(log, bytearray(b"10"), bytearray(b"2"))) == {"10": "a", "2": "c"}
    assert live(lookup.range_scan(log)) == {"10": "a", "2": "c", "\xff": "d"}
    assert live(lookup.prefix_scan(log, bytearray(b"1"))) == {"10": "a"}
    keys = spark.createDataFrame([(bytearray(b"10"),), (bytearray(b"11"),), (bytearray(b"nope"),), (bytearray(b"10"),)], "key binary")
    assert live(lookup.multi_get(log, keys)) == {"10": "a"}
    assert lookup.successor(b"a\xff") == b"b" and lookup.successor(b"\xff") is None


ops = st.lists(st.tuples(st.sampled_from(["a", "b", "", "\x7f", "é"]), st.one_of(st.none(), st.text("xy", max_size=3))), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops)
def test_like_a_dict(spark, writes):
    model = {}
    for key, value in writes:
        model.pop(key, None)
        if value is not None:
            model[key] = value
    log = log_of(spark, [f"-{k}" if v is None else f"+{k}={v}" for k, v in writes])
    assert live(resolve.snapshot(log)) == model
    assert live(resolve.as_of(log, len(writes))) == model
