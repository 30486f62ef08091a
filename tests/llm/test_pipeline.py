"""The pipeline's stages, each against brute force on its own input."""

import random

import pytest

from tests.llm.test_exact import classes_by_force, corpus, hits_by_force, lines_by_force, near_corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    junk = [" ".join(r.choice(["BUY", "NOW", "CHEAP"]) + "!!" for _ in range(30)) for _ in range(60)]
    good = corpus(22, 80) + [t and t.lower() for t in near_corpus()]
    texts = good + junk
    ids = r.sample(range(5000), len(texts))
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(n < len(good)), 0) for n, i in enumerate(ids) if n % 2 == 0 and texts[n]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(n, " ".join(good[20 + n].split()[:20])) for n in range(5) if good[20 + n]]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(zip(ids, texts)), set(ids[len(good) :]), items


def test_stages(spark, tables, tmp_path):
    import corpus_pipeline as p

    folder, texts, junk, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    held = []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        held.append({r.doc_id: r for r in docs.collect()})
    first, lines, near, clean, coded = held
    assert not set(first) & junk and len(first) >= 0.95 * (len(texts) - len(junk))
    ids = sorted(first)
    assert [(lines[i].text, lines[i].n_chars) for i in ids] == [(t, len(t)) for t, _, _ in lines_by_force([first[i].text for i in ids], 10)]
    classes = classes_by_force(ids, [lines[i].text for i in ids])
    assert set(near) == {i for i, c in classes.items() if i == c}
    ids = sorted(near)
    bad = {i for i, h in zip(ids, hits_by_force([near[i].text for i in ids], items, 10)) if h[-1]}
    assert bad and set(clean) == set(ids) - bad
    import hashlib

    assert {i: r.decoded_sha256 for i, r in coded.items()} == {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in clean.items()}
    assert {r.doc_id for r in p.run(spark, folder).select("doc_id").collect()} == set(coded)


def test_empty_documents(spark, tables, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, tables[0])
    assert docs.count() == 0
