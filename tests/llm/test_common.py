import os

import pyarrow as pa
import pytest
from tests.llm.helpers import LOWER, rows, words

from xylem.llm import common


def test_slices_and_words():
    texts = [r[1] for r in rows()] + ["Ab c"] * 50
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for most in (1, 40, 1 << 20):
        got = []
        for part in common.slices(batch, "text", most):
            n, flat = common.word_lists(part.column(0))
            flat, at = flat.to_pylist(), 0
            for k in n.tolist():
                got.append(flat[at : at + k])
                at += k
            assert at == len(flat)
        assert got == [words((t or "").translate(LOWER)) for t in texts]
    assert list(common.slices(batch.slice(0, 0), "text")) == []


def test_folders(spark, tmp_path):
    path = common.run_dir(spark)
    assert spark.sparkContext.applicationId in path and common.shared_dir(spark, "x").startswith(f"{path}/x-")
    (tmp_path / "run" / "part").mkdir(parents=True)
    common._removed(spark, f"file:{tmp_path}/run")
    assert not os.path.exists(tmp_path / "run")

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://x:1"
            getConf = staticmethod(dict)
            _jsc = spark.sparkContext._jsc

        conf = spark.conf

    kept = spark.conf.get("xylem.shared.dir", None)
    spark.conf.unset("xylem.shared.dir")
    try:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            with pytest.raises(ValueError, match="share"):
                common.checkpoint_root(Cluster)
    finally:
        if kept:
            spark.conf.set("xylem.shared.dir", kept)
