import time

import pyarrow as pa
import pytest

from keyloom.llm import packing, pfor, tokens


def kept_by_workers(spark) -> int:
    """The most words and pieces that an encoder of any worker at hand remembers."""

    def look(batches):
        for _ in batches:
            time.sleep(0.3)  # so that the tasks at one time meet different workers
            yield pa.RecordBatch.from_arrays([pa.array([max((len(e.words) + len(e.pieces) for e in tokens._encoders.values()), default=0)])], names=["n"])

    return max(r.n for r in spark.range(16, numPartitions=16).mapInArrow(look, "n long").collect())


@pytest.mark.parametrize("encode", (packing.pack, pfor.round_trip))
def test_what_encoders_have_learnt_goes_once_the_stage_is_over(spark, encode):
    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> concat('w', sha2(concat(id, '-', i), 256)))) AS text")
    assert encode(docs).count() >= 400
    time.sleep(3)
    assert kept_by_workers(spark) == 0


def test_an_encoder_remembers_between_tasks(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.4)
    path = tokens.resolve("byte_bpe_50k.json")
    with tokens.lent(path) as first:
        ids = first.encode("some words, more words")
    with tokens.lent(path) as second:
        assert second is first and "some" in first.words
        time.sleep(0.8)  # a task may take longer than that
        assert "some" in first.words
    time.sleep(1.2)
    assert not first.words and not first.pieces and first.encode("some words, more words") == ids
