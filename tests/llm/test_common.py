import os

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common as op


def test_saved_tables_leave_settings_as_they_were_and_can_be_removed(spark):
    before = {k: spark.conf.get(k, None) for k in op._MAKING}
    held = op.saved(spark.range(100).repartition(3, "id"), "some")
    assert {k: spark.conf.get(k, None) for k in op._MAKING} == before
    folder = held.saved_at.removeprefix("file:")
    assert held.count() == 100 and not [f for f in os.listdir(folder) if f.endswith(".crc")]
    op.discard(held)
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda k, d=None: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        op.shared_dir(Session)


def test_hashes_are_of_the_bytes_alone(monkeypatch):
    """However texts are cut into blocks, equal words have equal hashes and different ones don't."""
    rng = np.random.default_rng(0)
    vocabulary = ["w" * n + str(n) for n in (1, 3, 50, 300)] + ["é", "a"]
    text = " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), 400))
    want = op.words_of(pa.array([text])).hash
    monkeypatch.setattr(op, "BLOCK", 64)
    monkeypatch.setattr(op, "_TABLES", None)
    got = op.words_of(pa.array([text])).hash
    words = text.split(" ")
    short = [i for i, w in enumerate(words) if len(w.encode()) <= 64]
    assert (got[short] == want[short]).all() and len(set(got.tolist())) == len(set(words))
