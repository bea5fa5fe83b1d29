import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm


def total(docs, model):
    lm._files.cache_clear()
    lm._written.cache_clear()
    return docs and lm.score(docs.repartition(1), model).agg(F.sum("score")).first()[0]


def test_a_lost_or_cut_file_is_an_error(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").cache()
    model = lm.fit(docs)
    folder = model.uri.removeprefix("file://")
    whole = total(docs, model)
    kinds = ["bi-*.key.npy", "bi-*.count.npy", "word-*.key.npy", "word-*.stats.npy", "bi-written.npy", "word-written.npy"]
    for kind in kinds:
        path = sorted(glob.glob(f"{folder}/{kind}"))[0]
        os.rename(path, f"{path}.away")
        fresh = lm.Model(**{**vars(model), "uri": model.uri + "/"})  # another name, so that no worker has it mapped
        with pytest.raises(Exception, match="FileNotFound|No such file|not found|cannot find"):
            total(docs, fresh)
        os.rename(f"{path}.away", path)
        assert total(docs, model) == pytest.approx(whole, abs=1e-6)
    one, other = sorted(glob.glob(f"{folder}/bi-*.key.npy"))[:2]
    os.rename(one, f"{one}.away")
    os.link(other, one)
    with pytest.raises(Exception, match="keys and"):
        total(docs, lm.Model(**{**vars(model), "uri": model.uri + "//"}))


def test_shards_without_training_rows_are_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs.limit(1))
    assert model.tokens and total(docs, model) < 0
    assert len(lm._written(model.uri, "bi")[0]) <= 1 << model.bits
    empty = lm.fit(docs.limit(0))
    assert empty.tokens == 0 and total(docs, empty) == 0  # of no words the unknown one has all the mass
