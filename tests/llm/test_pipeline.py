import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from spanweave.llm import packing


def test_stages(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{int(300 * r.random())}" for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        t, q = text(60), int(i % 4 != 0)
        rows.append((i, t if q else " ".join(w + "%%%" for w in t.split()), ("en", "de")[i % 3 == 0], "s", len(t)))
        labels.append((i, q, 0))
    passage = text(30)
    rows += [(200, rows[1][1], "en", "s", 0), (201, f"{text(40)} {passage}", "en", "s", 0), (202, f"{passage} {text(40)}", "en", "s", 0), (203, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id: x for x in docs.collect()}
    assert all((i in kept["quality"]) == bool(q) for i, q, _ in labels)
    assert 200 not in kept["near_dedup"] and 1 in kept["near_dedup"]
    assert passage in kept["substring_dedup"][201].text and passage not in kept["substring_dedup"][202].text
    assert set(kept["mixing"]) == set(kept["substring_dedup"]) == set(kept["packing"])
    encode = packing.encoder(packing.default_tokenizer()).tokenizer.encode
    for i, row in kept["mixing"].items():
        assert kept["packing"][i].doc_tokens == len(encode(row.text or "", add_special_tokens=False).ids) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(1 for _ in docs.toLocalIterator())


STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(("_b", "_key", "_hit", "sid", "run", "rate", "_n", "won"))})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_nulls_repeats_long_texts_and_nothing(spark, tmp_path, name):
    """Rows with null columns, repeated rows, one very long text, columns of clashing names; then no rows, and no labels."""
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    rows = [(i, text(50), ("en", "de")[i % 2], "s", 1) for i in range(40)] + [(90, text(30_000), "en", "s", 1), (91, None, None, None, None), (None, text(40), "en", None, 3), (92, "", "de", "s", 0), (93, " \n", "de", "s", 0)]
    rows += [rows[3], rows[3]]
    docs = tables(spark, tmp_path, rows, [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(40)] + [(90, 1, None), (None, 1, 1)])
    out = STAGES[name](spark, docs, str(tmp_path))
    got = out.collect()
    ids = [x.doc_id for x in got]
    if name == "packing":
        whole = {}
        for x in got:
            whole[x.doc_id] = whole.get(x.doc_id, 0) + x.length
        assert set(whole) == {x[0] for x in rows} and whole[91] == 1 and whole[3] == 3 * next(x.doc_tokens for x in got if x.doc_id == 3)
    else:
        assert out.columns == docs.columns
        if name == "near_dedup":
            assert sorted(i for i in ids if i is not None) == [*range(40), 90, 91] and ids.count(None) == 1
        elif name == "substring_dedup":
            assert sorted(i for i in ids if i is not None) == sorted(x[0] for x in rows if x[0] is not None) and {x.text for x in got if x.doc_id == 3} == {rows[3][1]}
        elif name == "mixing":
            assert set(ids) == {x[0] for x in rows} and ids.count(3) % 3 == 0
    empty = STAGES[name](spark, docs.where("false"), str(tmp_path))
    assert empty.count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    unlabelled = STAGES[name](spark, docs, str(tmp_path / "none"))
    assert name == "quality" or unlabelled.count() > 0
