import pytest
from pyspark.sql import functions as F

from docveil.operators import gate
from docveil.streaming import outgoing

TEXTS = "out_id int, matter_id string, tool string, text string"
LOG = outgoing.LOG.format(out_id="int", matter_id="string")
VALUES = "matter_id string, label_type string, label string, value string"
FIRST = [("m", "PLAKA", "{{PLAKA-01}}", "34 ABC 123")]
SECOND = [*FIRST, ("m", "TELEFON", "{{TELEFON-01}}", "0532 111 22 33")]
BATCHES = [
    [(1, "m", "list", "car 34abc123"), (2, "m", "get", "call 0532 111 22 33"), (2, "m", "get", "call 0532 111 22 33"), (3, None, "get", "34 ABC 123"), (4, "m", "get", None)],
    [(5, "m", "get", "call 0532-111-2233, 34 ABC 123"), (6, "other", "get", "34 ABC 123"), (7, "m", "list", "")],
]


@pytest.fixture
def place(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, TEXTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        texts = spark.readStream.schema(TEXTS).parquet(str(tmp_path / "in"))
        outgoing.guarded(texts, str(tmp_path / "vault"), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()

    def read():
        return sorted((r.out_id, r.vault_version, r.characters, r.hits, r.cleaned) for r in outgoing.entries(spark, str(tmp_path / "log"), LOG).collect())

    return put, run, read, tmp_path


DONE = [(1, 1, 12, 1, "car {{PLAKA-01}}"), (2, 1, 19, 0, None), (2, 1, 19, 0, None), (3, 1, 10, 0, None), (4, 1, 0, 0, None)]
ALL = [*DONE, (5, 2, 30, 2, "call {{TELEFON-01}}, {{PLAKA-01}}"), (6, 2, 10, 0, None), (7, 2, 0, 0, None)]


def test_versions_and_restarts(spark, place, monkeypatch):
    put, run, read, path = place
    put(BATCHES[0])
    with pytest.raises(Exception, match="no version"):
        run()
    assert outgoing.publish(spark.createDataFrame(FIRST, VALUES), str(path / "vault")) == 1
    run()
    assert read() == DONE
    assert outgoing.publish(spark.createDataFrame(SECOND, VALUES), str(path / "vault")) == 2
    put(BATCHES[1])
    # it fails after the entries are written, before the ledger has them
    enter = outgoing._enter
    monkeypatch.setattr(outgoing, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    assert read() == DONE
    monkeypatch.setattr(outgoing, "_enter", enter)
    run()
    assert read() == ALL
    run()  # nothing new
    assert read() == ALL


def test_a_batch_that_the_ledger_has_is_not_done_again(spark, place):
    put, run, read, path = place
    outgoing.publish(spark.createDataFrame(FIRST, VALUES), str(path / "vault"))
    put(BATCHES[0])
    run()
    outgoing.publish(spark.createDataFrame(SECOND, VALUES), str(path / "vault"))
    # the checkpoint forgets that the batch is done: it runs again, under a newer vault
    for f in (path / "check" / "commits").iterdir():
        f.unlink()
    run()
    assert read() == DONE


def test_log_is_the_gate(spark):
    values = spark.createDataFrame(SECOND, VALUES)
    texts = spark.createDataFrame([r for b in BATCHES for r in b], TEXTS)
    hits = {r.out_id: r.n for r in gate.gate(texts.dropDuplicates(), values).groupBy("out_id").agg(F.sum("hits").alias("n")).collect()}
    got = outgoing.logged(texts, gate.value_forms(values), 7).collect()
    assert len(got) == 8 and all(r.hits == hits.get(r.out_id, 0) and r.vault_version == 7 for r in got)
    assert outgoing.logged(spark.createDataFrame([], TEXTS), gate.value_forms(values), 1).count() == 0
