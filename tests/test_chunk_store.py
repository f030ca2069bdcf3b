import os

import pytest

from lexivec.config import Config
from lexivec.operators.chunk import recursive_chunks
from lexivec.sources import chunk_store
from lexivec.sources.chunk_store import ChunkStore


def small(docs):
    return recursive_chunks(docs, Config(chunk_tokens=6, min_chunk_tokens=1))


def rows(store):
    return sorted(map(tuple, store.chunks().collect())), sorted(map(tuple, store.documents().collect()))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def texts():
    return {f"d{i:03}": f"text number {i} has some words in it, and then some more. " * (i % 4) for i in range(200)} | {"none": None}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_a_second_ingest_rewrites_only_what_changed(spark, tmp_path, texts):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=40, chunker=small)
    assert store.chunks().count() == 0
    assert store.ingest(frame(spark, texts), dry_run=True) == {"new": 201, "changed": 0, "same": 0, "gone": 0, "partitions": 40} and not os.path.exists(tmp_path / "store")
    assert store.ingest(frame(spark, texts))["new"] == 201
    before = files(tmp_path / "store")
    assert store.ingest(frame(spark, texts)) == {"new": 0, "changed": 0, "same": 201, "gone": 0, "partitions": 0} and files(tmp_path / "store") == before
    later = {k: v for k, v in texts.items() if k != "d010"} | {"d011": "quite another text", "d012": "", "new": "a new one of several words, more than six."}
    done = store.ingest(frame(spark, later))
    # d012 was empty before; a null text is an empty one.
    assert {k: done[k] for k in ("new", "changed", "same", "gone")} == {"new": 1, "changed": 1, "same": 199, "gone": 1} and done["partitions"] <= 3
    after = files(tmp_path / "store")
    touched = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert all(after[f] == t for f, t in before.items() if f in after) and len(touched) <= 2 * done["partitions"]
    whole = ChunkStore(spark, str(tmp_path / "whole"), buckets=7, chunker=small)
    whole.ingest(frame(spark, later))
    assert rows(store) == rows(whole) and dict((d, n) for d, _, n in rows(store)[1])["none"] == 0


def test_partitions_without_documents_go_and_limits_keep_others(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=1000, chunker=small)
    store.ingest(frame(spark, {"a": "one two three", "b": "four five six", "c": "seven eight nine"}))
    assert store.ingest(frame(spark, {"b": "four five six"})) == {"new": 0, "changed": 0, "same": 1, "gone": 2, "partitions": 2}
    assert [r["doc_id"] for r in store.chunks().collect()] == ["b"]
    done = store.ingest(frame(spark, {"a": "ten", "c": "eleven", "d": "twelve"}), limit=2)
    assert done == {"new": 2, "changed": 0, "same": 0, "gone": 0, "partitions": 2} and sorted(r["doc_id"] for r in store.documents().collect()) == ["a", "b", "c"]


def test_a_limit_keeps_other_documents_of_the_same_partition(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=1, chunker=small)
    store.ingest(frame(spark, {"a": "one two", "b": "three four", "c": "five six"}))
    assert store.ingest(frame(spark, {"a": "seven", "d": "eight"}), limit=1)["changed"] == 1
    assert sorted((r["doc_id"], r["text"]) for r in store.chunks().collect()) == [("a", "seven"), ("b", "three four"), ("c", "five six")]
    assert sorted((r["doc_id"], r["n_chunks"]) for r in store.documents().collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_an_ingest_that_stops_before_its_digests_is_done_again(spark, tmp_path, monkeypatch):
    texts = {f"d{i}": f"words of text {i} and more" for i in range(30)}
    later = texts | {"d3": "other words", "d4": None}
    store = ChunkStore(spark, str(tmp_path / "store"), buckets=1, chunker=small)
    store.ingest(frame(spark, texts))
    digests = files(tmp_path / "store" / "documents")

    class Stopped(Exception):
        pass

    def stop(spark, path):
        raise Stopped(path)

    # A document whose partition has no chunk left makes the ingest remove it; that is where it stops.
    lone = ChunkStore(spark, str(tmp_path / "lone"), buckets=1, chunker=small)
    lone.ingest(frame(spark, {"d": "some words"}))
    monkeypatch.setattr(chunk_store, "remove", stop)
    with pytest.raises(Stopped):
        lone.ingest(frame(spark, {"d": None}))
    monkeypatch.undo()
    assert lone.compare(frame(spark, {"d": None})).first()["status"] == "changed"
    lone.ingest(frame(spark, {"d": None}))
    assert lone.chunks().count() == 0 and [(r["doc_id"], r["n_chunks"]) for r in lone.documents().collect()] == [("d", 0)]
    assert store.ingest(frame(spark, later))["changed"] == 2 and files(tmp_path / "store" / "documents") != digests
    whole = ChunkStore(spark, str(tmp_path / "whole"), buckets=5, chunker=small)
    whole.ingest(frame(spark, later))
    assert rows(store) == rows(whole)
