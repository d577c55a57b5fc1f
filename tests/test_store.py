"""The store in a folder: writes, reads, transactions, compaction, re-typing, backup."""

import pytest

from tripleframe.engine import BATCH, Engine
from tripleframe.functions.cid import Cid
from tripleframe.operators.registry import Registry

KNOWS, AGE, OTHER = (Cid.predicate(x) for x in ("R:rel:knows", "R:attr:age", "R:un:registered"))
A, B, D = (Cid.of(x) for x in "abd")


def raw(x):
    return None if x is None else bytearray(x.raw)


@pytest.fixture
def engine(spark, tmp_path):
    reg = Registry()
    reg.register_term("R:rel:knows", "multivalue_set", "why")
    reg.register_term("R:attr:age", "counter")
    return Engine(spark, f"file://{tmp_path}/store", reg)


def batch(spark, *rows):
    return spark.createDataFrame([(i, raw(s), raw(p), raw(o) if isinstance(o, Cid) else None, o if isinstance(o, str) else None, o if isinstance(o, int) else None) for i, (s, p, o) in enumerate(rows)], BATCH)


def objects(df):
    return sorted((bytes(r.o_cid) if r.o_cid else r.o_int) for r in df.collect())


def test_triples(engine, spark):
    assert engine.query(A, AGE).first().o_int == 0
    stats = engine.insert_triples(batch(spark, (A, KNOWS, B), (A, KNOWS, B), (A, KNOWS, D), (A, AGE, 10), (A, AGE, "25"), (A, OTHER, "text"), (None, AGE, 3)))
    assert stats == {"inserted": 6, "failed": 1, "specialized": 5, "composite": 1}
    assert objects(engine.query(A, KNOWS)) == sorted([B.raw, D.raw]) and objects(engine.query(A, AGE)) == [25]
    assert engine.has_composite(A, OTHER, Cid.of("text")) and not engine.has_composite(A, OTHER, Cid.of("else"))
    assert engine.query(A, OTHER).count() == 0
    assert engine.text_of(spark.createDataFrame([(raw(Cid.of("text")),)], "cid binary")).first().text == "text"
    gone = {r.ord: r.existed for r in engine.delete_triples(batch(spark, (A, KNOWS, B), (B, KNOWS, A), (A, AGE, 9), (A, AGE, 25))).collect()}
    assert gone == {0: True, 1: False, 2: False, 3: True}
    assert objects(engine.query(A, KNOWS)) == [D.raw] and engine.query(None, AGE, 25).count() == 0
    engine.compact()
    assert objects(engine.query(A, KNOWS)) == [D.raw] and engine.has_composite(A, OTHER, Cid.of("text"))
    engine.insert_triples(batch(spark, (A, AGE, 7)))
    assert objects(engine.query(A, AGE)) == [7]
    engine.hot_reload(KNOWS, "counter")
    assert objects(engine.query(A, KNOWS)) == [1] and objects(engine.query(A, AGE)) == [7]
    engine.backup(f"{engine.path}-copy")
    assert objects(Engine(spark, f"{engine.path}-copy").query(A, KNOWS)) == [1]
    assert [r.name for r in engine.audit()["unjustified"].collect()] == ["R:attr:age"]
    assert engine.counts["rows"] >= 10


def test_multimap(engine, spark):
    pairs = spark.createDataFrame([(i, raw(A), raw(v)) for i, v in enumerate((B, D, B, A))], "ord long, key binary, value binary")
    engine.insert(pairs)
    keys = pairs.select("key")
    assert [bytes(r.value) for r in engine.get(keys).orderBy("slot").collect()] == [B.raw, D.raw, A.raw]
    engine.delete(spark.createDataFrame([(0, raw(A), raw(D))], "ord long, key binary, value binary"))
    assert [bytes(r.value) for r in engine.get(keys).orderBy("slot").collect()] == [B.raw, A.raw]
    assert engine.bucket_stats(4).first().entry_count == 2
    engine.delete(spark.createDataFrame([(0, raw(A))], "ord long, key binary"))
    assert engine.get(keys).count() == 0
    with pytest.raises(Exception, match="zero identifier"):
        engine.insert(spark.createDataFrame([(0, raw(A), bytearray(32))], "ord long, key binary, value binary"))
    assert engine.get(keys).count() == 0


def test_transactions(engine, spark):
    engine.begin()
    engine.insert_triples(batch(spark, (A, KNOWS, B)))
    with pytest.raises(RuntimeError):
        engine.begin()
    assert engine.commit() == {"operations": 1}
    engine.begin(staged=True)
    engine.insert_triples(batch(spark, (A, KNOWS, D)))
    assert objects(engine.query(A, KNOWS)) == [B.raw]
    engine.rollback()
    assert objects(engine.query(A, KNOWS)) == [B.raw]
    engine.begin(staged=True)
    engine.insert_triples(batch(spark, (A, KNOWS, D)))
    engine.commit()
    assert engine.query(A, KNOWS).count() == 2


def test_a_store_reopens_and_restores(engine, spark):
    engine.insert_triples(batch(spark, (A, KNOWS, B), (A, AGE, 5), (A, OTHER, "text")))
    again = Engine(spark, engine.path)
    assert [e.name for e in again.registry.entries.values()] == ["R:rel:knows", "R:attr:age"] and again.registry.get(KNOWS).justification == "why"
    assert objects(again.query(A, KNOWS)) == [B.raw] and objects(again.query(A, AGE)) == [5]
    engine.backup(f"{engine.path}-saved")
    later = engine._rows(spark.createDataFrame([(0, raw(A), raw(AGE), None, 9)], "ord long, key binary, p binary, value binary, o_int long"), "triple", "INSERT")
    back = Engine.restore(spark, f"{engine.path}-saved", f"{engine.path}-back", later)
    assert objects(back.query(A, AGE)) == [9] and objects(back.query(A, KNOWS)) == [B.raw] and back.has_composite(A, OTHER, Cid.of("text"))
    assert back.text_of(spark.createDataFrame([(raw(Cid.of("text")),)], "cid binary")).first().text == "text"
    assert Engine(spark).query(A, AGE).count() == 0


def test_writers_never_share_a_batch(engine, spark):
    from concurrent.futures import ThreadPoolExecutor

    others = [Engine(spark, engine.path, engine.registry) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: x[1].insert_triples(batch(spark, *((Cid.of(f"s{x[0]}"), KNOWS, Cid.of(f"o{x[0]} {i}")) for i in range(5)))), enumerate(others)))
    assert engine.store().everything().count() == 20 and len(engine._complete("log")) == 4
    names = {engine._name("log", "batch=") for _ in range(5)}
    assert len(names) == 5


def test_a_write_during_compaction_stays(engine, spark, monkeypatch):
    engine.insert_triples(batch(spark, (A, KNOWS, B), (A, AGE, 1)))
    from tripleframe.sources import tables

    save, other = tables.save_kv, Engine(spark, engine.path, engine.registry)

    def meanwhile(*args, **kwargs):
        other.insert_triples(batch(spark, (A, KNOWS, D), (A, AGE, 2)))
        save(*args, **kwargs)

    monkeypatch.setattr(tables, "save_kv", meanwhile)
    engine.compact()
    monkeypatch.undo()
    assert objects(engine.query(A, KNOWS)) == sorted([B.raw, D.raw]) and objects(engine.query(A, AGE)) == [2]
    assert objects(engine.query(None, KNOWS, D)) == [] or engine.query(None, KNOWS, D).first().s == bytearray(A.raw)
    assert engine.query(None, AGE, 1).count() == 0 and engine.query(None, AGE, 2).count() == 1
    path, fs = engine._at("base", "v9-crashed", "spo", "x")
    fs.create(path).close()
    engine.compact()
    assert objects(engine.query(A, AGE)) == [2] and engine.truncate() >= 2
    assert objects(engine.query(A, KNOWS)) == sorted([B.raw, D.raw])
    assert {r.name for r in engine.metrics().collect()} >= {"rows", "open_batches", "versions"}


def test_patterns_read_the_layout_of_their_terms(engine, spark):
    engine.insert_triples(batch(spark, *((Cid.of(f"s{i}"), KNOWS, Cid.of(f"o{i % 7}")) for i in range(60)), *((Cid.of(f"s{i}"), AGE, i % 5) for i in range(60))))
    engine.compact()
    engine.insert_triples(batch(spark, (Cid.of("s1"), AGE, 3), (Cid.of("s3"), AGE, 9)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    by_object, by_subject = engine.query(None, KNOWS, Cid.of("o3")), engine.query(Cid.of("s5"), KNOWS)
    assert any("/osp/" in f for f in by_object.inputFiles()) and "EqualTo(o_cid" in plan(by_object) and "PartitionFilters: [isnotnull(pred" in plan(by_object)
    assert any("/spo/" in f for f in by_subject.inputFiles()) and "EqualTo(s," in plan(by_subject)
    assert not any("/spo/" in f for f in by_object.inputFiles()) and not any("/osp/" in f for f in by_subject.inputFiles())
    assert by_object.count() == len([i for i in range(60) if i % 7 == 3]) and objects(by_subject) == [Cid.of("o5").raw]
    three = {bytes(r.s) for r in engine.query(None, AGE, 3).collect()}
    assert three == {Cid.of(f"s{i}").raw for i in range(60) if i % 5 == 3 and i != 3} | {Cid.of("s1").raw}
