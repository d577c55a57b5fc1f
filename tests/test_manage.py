import pytest
from pyspark.sql import functions as F

from tripleframe.operators import ext, manage
from tripleframe.operators.registry import Counter, MultiValueSet, Plugin, PluginRegistry
from tripleframe.streaming import apply, notify


class Broken(Plugin):
    name, needs = "broken", "1.2"

    def fold(self, log):
        raise ValueError("broken")


def test_options_and_versions():
    assert manage.schema("counter") == {"initial": "int", "overflow": "str"}
    assert manage.option_errors("counter", {"initial": 1}) == []
    assert manage.option_errors("counter", {"initial": "x", "other": 1}) == ["initial is not of type int", "counter has no option other"]
    assert manage.compatible(Broken, "1.2.9") and not manage.compatible(Broken, "1.1") and manage.compatible(Counter, "0.1")
    plugins = PluginRegistry()
    assert set(manage.discovered(plugins, ext.__name__)) == {"single_value", "accumulator", "enum", "boolean", "bloom_filter"} == set(plugins.list())


def test_guarded_plugins(spark):
    rows = spark.createDataFrame([(bytearray(b"s"), 1)], "s binary, o_int long")
    with pytest.raises(ValueError):
        manage.Guarded(Broken()).fold(rows)
    guarded = manage.Guarded(Broken(), mode="log", most=2)
    for _ in range(5):
        assert guarded.fold(rows).count() == 0
    assert guarded.disabled and len(guarded.errors) == 3


def test_ontology_configurations(spark):
    rows = spark.createDataFrame([("R:a:b", "counting"), ("R:a:c", "text"), ("R:a:d", "odd"), ("R:a:e", None)], "term string, category string")
    got = {r.term: tuple(r)[1:] for r in manage.from_ontology(rows).collect()}
    assert got == {"R:a:b": ("counter", 50, True, True), "R:a:c": ("fulltext", 2, False, False), "R:a:d": ("single_value", 20, True, True), "R:a:e": ("single_value", 20, True, True)}


def test_streams_survive_a_restart_and_notify(spark, tmp_path):
    kind = "s binary, o binary, op string, ord long"
    source = f"{tmp_path}/in"

    def put(*rows):
        spark.createDataFrame([(bytearray(s), bytearray(o), op, n) for s, o, op, n in rows], kind).coalesce(1).write.mode("append").parquet(source)

    state = apply.State(spark, f"{tmp_path}/state", apply.folded_set)
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    put((b"a", b"x", "INSERT", 1), (b"a", b"y", "INSERT", 2))
    stream().writeStream.foreachBatch(notify.with_notifications(state.apply, f"{tmp_path}/told")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    put((b"a", b"x", "DELETE", 3), (b"b", b"x", "INSERT", 4))
    apply.consume(stream(), state, f"{tmp_path}/c")
    assert {(bytes(r.s), bytes(r.o)) for r in state.current().collect()} == {(b"a", b"y"), (b"b", b"x")}
    assert state.latest() == 1
    told = spark.read.parquet(f"{tmp_path}/told")
    assert told.where("topic = 'heartbeat'").count() == 1 and told.where("topic = 'insert'").count() == 2


def test_guarded_folds_that_fail_while_they_run(spark):
    class Late(Counter):
        name = "late"

        def fold(self, rows):
            return rows.select("s", F.raise_error(F.lit("too late")).cast("binary").alias("o_cid"), F.lit(1).cast("long").alias("o_int"))

    rows = spark.createDataFrame([(b"a",)], "s binary")
    guarded = manage.Guarded(Late(), mode="log")
    assert guarded.fold(rows, checked=True).count() == 0 and "too late" in guarded.errors[0]
    assert manage.Guarded(Late(), mode="log").fold(rows).count() == 1  # lazy: nothing was read of the failing column


def test_migrations_take_the_shortest_way(spark):
    ways = manage.Migrations()
    for old, new in (("1", "2"), ("2", "3"), ("1", "3"), ("3", "4")):
        ways.add("counter", old, new, lambda df, by=f"{old}>{new} ": df.withColumn("path", F.concat("path", F.lit(by))))
    assert ways.run(spark.createDataFrame([("",)], "path string"), "counter", "1", "4").first().path == "1>3 3>4 "
    with pytest.raises(ValueError, match="no way"):
        ways.way("counter", "4", "1")


def test_set_options(spark):
    log = spark.createDataFrame([("INSERT", 1, b"a", b"x"), ("INSERT", 2, b"a", b"y"), ("INSERT", 3, b"a", b"x"), ("DELETE", 4, b"a", b"y"), ("INSERT", 5, b"a", b"z")], "op string, ord long, s binary, o_cid binary")
    members = lambda **options: sorted((bytes(r.s), bytes(r.o_cid)) for r in MultiValueSet(**options).fold(log).collect())
    assert members() == [(b"a", b"x"), (b"a", b"z")] and members(max_size=1) == [(b"a", b"x")]
    assert members(deduplication=False) == [(b"a", b"x"), (b"a", b"x"), (b"a", b"z")]
    assert members(symmetric=True) == [(b"a", b"x"), (b"a", b"z"), (b"x", b"a"), (b"z", b"a")]


def test_stream_state_rewrites_touched_parts_only(spark, tmp_path):
    state = apply.State(spark, f"{tmp_path}/state", apply.folded_set, parts=4, keep=1)
    kind = "s string, o string, op string, ord long"
    state.apply(spark.createDataFrame([(f"s{i}", "o", "INSERT", i) for i in range(40)], kind), 0)
    before = state._paths(0)
    state.apply(spark.createDataFrame([("s1", "o", "DELETE", 100)], kind), 1)
    changed = {k for k, v in state._paths(1).items() if v != before.get(k)}
    assert len(before) == 4 and len(changed) == 1 and state.current().count() == 39
    state.apply(spark.createDataFrame([("s1", "p", "INSERT", 101)], kind), 3)
    assert state.current().count() == 40 and state.read().where("op = 'DELETE'").count() == 0
