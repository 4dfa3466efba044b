"""What a task's numpy arrays take on a batch of long texts, whatever the batch holds."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations, jaccard


class Caught(Exception):
    pass


class Rows:
    """Stands for a table whose tasks are run here."""

    def mapInArrow(self, f, schema):
        raise Caught(f)


def peak(job, batch: pa.RecordBatch, times: int = 1) -> float:
    """MB at the peak of the first task that ``job`` gives to Spark."""
    with pytest.raises(Caught) as caught:
        job(Rows())
    tracemalloc.start()
    for _ in caught.value.args[0](iter([batch] * times)):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


@pytest.fixture(scope="module")
def texts() -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(9000)])
    rows = [" ".join(vocabulary[rng.integers(0, 9000, 340)]) for _ in range(5000)]  # some 10 MB
    return pa.record_batch([pa.array(range(5000), pa.int64()), pa.array(["en"] * 5000), pa.array(rows)], names=["doc_id", "lang", "text"])


def test_signatures_are_dealt_out_in_pieces(texts):
    assert peak(lambda docs: jaccard.suspects(docs, 50), texts) < 45


def test_counted_pairs_are_handed_on(texts):
    assert peak(lambda docs: collocations._bloom(docs, 30, lambda w: iter([np.unique(w.hashes()[1][w.pairs()], return_counts=True)])), texts) < 75
