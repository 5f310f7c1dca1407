import base64
import random

import pytest

from loomshift.sources import kvql
from loomshift.sources.kv import BadRequest, KVClient, KVStore, NotFound, Op
from loomshift.streaming.ingest import ingest_stream


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, f"file://{tmp_path}/kv")


def keys(df):
    return [bytes(r["key"]).decode() for r in df.collect()]


def test_put_get_delete_scan(store):
    store.batch([Op("put", c.encode(), c.encode()) for c in "abcde"])
    assert keys(store.scan("b", "d")) == ["b", "c"] and keys(store.scan(limit=2, offset=1)) == ["b", "c"]
    store.put("a", "2")
    store.delete("b")
    store.delete("missing")
    assert store.get("a") == b"2"
    with pytest.raises(NotFound):
        store.get("b")
    store.put("b", "again")
    assert store.get("b") == b"again" and [k for k, _ in store.stream("b", "d")] == [b"b", b"c"]
    before = store.scan().collect()
    store.compact()
    assert store.scan().collect() == before and store.stats()["batches"] == 1 and store.stats()["keys"] == 5


def test_later_writes_of_a_batch_win_and_bad_batches_write_nothing(store):
    store.batch([Op("put", b"k", b"1"), Op("delete", b"k"), Op("put", b"k", b"3")])
    assert store.get("k") == b"3"
    with pytest.raises(BadRequest):
        store.batch([Op("put", b"x", b"1"), Op("put", b"", b"1")])
    assert keys(store.scan()) == ["k"]


def test_bytes_order(store):
    store.batch([Op("put", k, b"v") for k in (b"\xff", b"\x00", b"a", b"\x7f\x80")])
    assert [bytes(r["key"]) for r in store.scan().collect()] == [b"\x00", b"a", b"\x7f\x80", b"\xff"]


def test_merge_newest_wins(store, spark):
    new = spark.createDataFrame([(b"a", b"new"), (b"b", None)], "key binary, value binary")
    old = spark.createDataFrame([(b"a", b"old"), (b"b", b"old"), (b"c", b"old")], "key binary, value binary")
    assert [(bytes(r.key), bytes(r.value)) for r in store.merged([new, old]).collect()] == [(b"a", b"new"), (b"c", b"old")]


def test_random_history_equals_a_dict(store):
    rng, model = random.Random(3), {}
    for _ in range(12):
        ops = []
        for _ in range(rng.randint(1, 6)):
            k = str(rng.randint(0, 15)).encode()
            if rng.random() < 0.3:
                ops.append(Op("delete", k))
                model.pop(k, None)
            else:
                v = str(rng.random()).encode()
                ops.append(Op("put", k, v))
                model[k] = v
        store.batch(ops)
    assert [(bytes(r["key"]), bytes(r["value"])) for r in store.scan().collect()] == sorted(model.items())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("get user:1", kvql.Get("user:1")),
        ('GET "a\\nb\\"c"', kvql.Get('a\nb"c')),
        ("PUT k 'v w'", kvql.Write((Op("put", b"k", b"v w"),), "PUT")),
        ("DELETE k trailing", kvql.Write((Op("delete", b"k"),), "DELETE")),
        ("SCAN LIMIT 5 TO z FROM a", kvql.Scan("a", "z", 5)),
        ("SCAN", kvql.Scan()),
        ("BATCH { PUT a b DELETE c }", kvql.Write((Op("put", b"a", b"b"), Op("delete", b"c")), "BATCH")),
    ],
)
def test_parse(text, want):
    assert kvql.parse(text) == want


@pytest.mark.parametrize("text", ["", "GET", "GET 12", "PUT k", "BATCH { }", "BATCH { GET a }", "SCAN LIMIT x", "GET 'open", "FETCH a", "GET a; b" * 0 + "GET ;"])
def test_syntax_errors(text):
    with pytest.raises(kvql.KVSyntax):
        kvql.parse(text)


def test_notes_and_client(store):
    client = KVClient(store)
    with client.batch() as b:
        b.put("notes:a", "first").put("notes:b", "second").put("other", "x").delete("none")
    assert client.scan("notes:", "notes:zz", 100) == [("notes:a", b"first"), ("notes:b", b"second")]
    built = kvql.QueryBuilder().scan().from_("notes:").to("notes:zz").limit(1).build()
    assert built == 'SCAN FROM "notes:" TO "notes:zz" LIMIT 1'
    assert client.query_raw(built)["pairs"] == [{"key": "notes:a", "value": base64.b64encode(b"first").decode()}]
    assert client.query_raw("GET nothing")["code"] == "not_found" and client.query_raw("GET")["code"] == "bad_request"
    assert client.query_raw(kvql.QueryBuilder().batch(kvql.QueryBuilder().put("q", "1"), kvql.QueryBuilder().delete("other")).build())["affected"] == 2
    assert client.get_str("q") == "1" and client.get("other") is None


def test_stream(store, spark, tmp_path):
    spark.createDataFrame([(b"s1", b"a"), (b"s2", b"b")], "key binary, value binary").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key binary, value binary").parquet(f"{tmp_path}/in")
    ingest_stream(stream, store, f"{tmp_path}/ck").awaitTermination(120)
    assert keys(store.scan()) == ["s1", "s2"]


def test_an_epoch_that_runs_again_after_a_later_write_changes_nothing(store, spark):
    pairs = spark.createDataFrame([(b"k", b"from the stream")], "key binary, value binary")
    store.ingest(pairs, source="s", epoch=3)
    store.put("k", "later")
    store.ingest(pairs, source="s", epoch=3)
    store.ingest(pairs, source="s", epoch=2)
    assert store.get("k") == b"later"
    store.ingest(pairs, source="s", epoch=4)
    assert store.get("k") == b"from the stream"


def test_a_failed_flush_keeps_its_operations(store):
    client = KVClient(store)
    writer = client.batch()
    writer.put("a", "1").put("", "2")
    with pytest.raises(BadRequest):
        writer.flush()
    assert len(writer.ops) == 2
    writer.ops.pop()
    assert writer.flush() == 1 and writer.ops == [] and client.get("a") == b"1"


def test_compaction_leaves_batches_to_their_readers(store, monkeypatch):
    from loomshift.sources import kv, storage

    store.put("a", "1")
    store.put("b", "2")
    planned = store.scan()
    store.compact()
    assert keys(planned) == ["a", "b"] and store.health()["status"] == "ok"
    monkeypatch.setattr(kv, "READERS_SECONDS", -1.0)
    monkeypatch.setattr(storage, "READERS_SECONDS", -1.0)
    store.put("c", "3")
    store.compact()
    assert keys(store.scan()) == ["a", "b", "c"] and len(store.manifest.files.names(f"{store.root}/batches")) == 1
